"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` = 3 bits share at
least 8 - 3 = 5 of their 8 bytes at the same positions. Posting lists of one
byte would hold a 256th of all rows, so a list is kept for each block of a
Steiner system S(3, 4, 8): 14 blocks of four positions, such that any five
shared positions contain a whole block. A list is thus keyed by four
positional bytes (2^32 values). Pairs met in a list are tallied: the number of
equal positional bytes must reach the guaranteed minimum, then the differing
bits are counted.

A list with more than LIST_CAP different fingerprints is not paired at all.
There a link x-y exists exactly if some z has d(x, z) <= 1 and d(z, y) <= 2,
so each member names its neighbours at up to 2 bits among the 32 bits that the
list leaves free, and members that name a common z, with one of them within 1
bit, are joined. That is linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.operators.components import connected_components
from tidemark.storage import materialize

SEED, SHINGLE, MAX_BITS, LIST_CAP, HASHES_AT_ONCE = 42, 3, 3, 256, 1 << 16


def blocks() -> list[tuple[int, ...]]:
    """The 14 blocks: 4-subsets of the points of GF(2)^3 whose XOR is zero."""
    return [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


BLOCKS = blocks()


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the ASCII-lower-cased text's word shingles, repeats included.

    Null or wordless: 0. Fewer words than a shingle: their whole sequence.
    Shingles are hashed in runs of HASHES_AT_ONCE, so memory follows the text.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    width = min(SHINGLE, len(tokens))
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(tokens) - width + 1]
    end = end[width - 1:]
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(start), HASHES_AT_ONCE):
        part = [digest(joined[a:z], SEED) for a, z in zip(start[i:i + HASHES_AT_ONCE].tolist(), end[i:i + HASHES_AT_ONCE].tolist())]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, fp), and key where key_col names a string column: fp is the fingerprint as a signed long; one row per input row."""
    names = ["id", "fp"] + ["key"] * (key_col is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *keys in slices(batches):
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps), *[pa.array(k, pa.string()) for k in keys]], names=names)

    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")] + ([F.col(key_col).alias("key")] if key_col else [])
    return docs.select(*cols).mapInArrow(run, "id long, fp long" + ", key string" * (key_col is not None))


def _as_bytes(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)


def linked(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Index pairs (i < j) of the fingerprints that link: tally of equal bytes, then bits."""
    by = _as_bytes(fps)
    tally = (by[:, None, :] == by[None, :, :]).sum(axis=2)
    i, j = np.nonzero(np.triu(tally >= 8 - max_bits, 1))
    ok = np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= max_bits
    return np.stack([i[ok], j[ok]], axis=1)


def _spanning(fps: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that suffice to connect what the given pairs connect: at most len(fps) - 1."""
    root, out = list(range(len(fps))), []
    for i, j in pairs.tolist():
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[j] = i
            out.append((i, j))
    return [(int(fps[i]), int(fps[j])) for i, j in out]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        by = _as_bytes(fps).astype(np.int64)
        for k, b in enumerate(BLOCKS):
            key = by[:, b[0]] | by[:, b[1]] << 8 | by[:, b[2]] << 16 | by[:, b[3]] << 24
            yield pa.RecordBatch.from_arrays([pa.array(key << 4 | k), pa.array(fps)], names=["key", "fp"])


def _scan_lists(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, (a, b, hot) out: links that span each list, or a row (fp, key, true) for each member of a long one."""
    def emit(key: int, held: list[int]) -> list[tuple[int, int, bool]]:
        if len(held) < 2:
            return []
        fps = np.array(held, dtype=np.int64)
        return [(a, b, False) for a, b in _spanning(fps, linked(fps))]

    def pack(rows: list) -> pa.RecordBatch:
        a, b, hot = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot, pa.bool_())], names=["a", "b", "hot"])

    last, held, long, out = None, [], False, []
    for batch in batches:
        for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                if not long and len(held) > 1:
                    out += emit(last, held)
                last, held, long = key, [], False
            if long:
                out.append((fp, key, True))
            else:
                held.append(fp)
                if len(held) > cap:
                    out += [(x, key, True) for x in held]
                    held, long = [], True
        if len(out) > 20_000:
            yield pack(out)
            out = []
    if not long and len(held) > 1:
        out += emit(last, held)
    if out:
        yield pack(out)


def _free_flips(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of up to two bits outside block k's bytes, and whether each has at most one bit."""
    bits = [8 * p + i for p in range(8) if p not in BLOCKS[k] for i in range(8)]
    few = [0, *(1 << x for x in bits)]
    two = [1 << x | 1 << y for x, y in combinations(bits, 2)]
    return np.array([*few, *two], dtype=np.uint64), np.array([True] * len(few) + [False] * len(two))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = [_free_flips(k) for k in range(len(BLOCKS))]
    for batch in batches:
        for fp, key in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
            flips, near = masks[int(key) & 15]
            z = (np.uint64(int(fp) & 0xFFFFFFFFFFFFFFFF) ^ flips).view(np.int64)
            n = len(z)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(z), pa.array(near), pa.array(np.full(n, fp))], names=["key", "z", "near", "fp"])


def links(distinct_fps: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """(a, b) fingerprints, enough of the links to connect all that link; input (fp) without repeats."""
    keyed = distinct_fps.select("fp").mapInArrow(_keys, "key long, fp long")
    lists = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _scan_lists(b, cap), "a long, b long, hot boolean")
    found = materialize(lists, "simhash-links")
    hot = found.where("hot").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    # a set here has at most 1 + 32 + 496 members: those within two bits of z
    met = (hot.mapInArrow(_balls, "key long, z long, near boolean, fp long").groupBy("key", "z")
           .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"), F.bool_or("near").alias("near")).where("near and size(all) > 1"))
    stars = met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return found.where("not hot").select("a", "b").unionAll(stars)


def _with_component(nodes: DataFrame, cap: int) -> DataFrame:
    """nodes, a row a fingerprint, with component: one fingerprint that stands for all reachable ones."""
    label = connected_components(links(nodes.select("fp"), cap))
    return nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = LIST_CAP) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id whose fingerprint is reachable.

    Nulls: a null text has fingerprint 0, as one without words; a null id is
    kept, never the smallest, and its component is null only if all ids in it
    are. Repeated rows are rows of their own. Fingerprints, not ids, are the
    nodes, so rows that share an id are not linked by that. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    joined = materialize(_with_component(rows.groupBy("fp").agg(F.min("id").alias("least_id")), cap), "simhash-nodes")
    least = joined.groupBy("component").agg(F.min("least_id").alias("least"))
    named = joined.join(least, "component").select("fp", F.col("least").alias("component"))
    return rows.join(named, "fp").select("id", "fp", "component")


def _row_key(docs: DataFrame, text_col: str) -> Column:
    """Hash of the text, then hash of the other columns: equal for equal rows only."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    return F.concat(F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit("-")), F.sha2(rest, 256))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = LIST_CAP) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that of its smallest id.

    Of a component's rows with that id the one whose text has the smallest
    hash stays, then that whose other columns have. Rows whose id is null are
    in components like others and stay only where no row of their component
    has an id (one row a component). Rows that share an id, or have none, are
    not linked by that: each component keeps its own. Columns are those of docs.
    """
    keyed = docs.withColumn("__key", _row_key(docs, text_col))
    rows = materialize(fingerprints(keyed, id_col, text_col, "__key"), "simhash-fps")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    nodes = materialize(rows.groupBy("fp").agg(first), "simhash-nodes")
    keep = _with_component(nodes, cap).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key"))
    # rows of one key are equal, so that any of them will do
    return keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
