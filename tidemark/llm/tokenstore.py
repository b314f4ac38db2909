"""Token ids of documents in files: one flat id array a part and Elias-Fano document boundaries.

A part has two files. ``part-k-j.ids``: ids one after another, unsigned 16-bit
where the vocabulary allows, else 32-bit, little-endian. ``part-k-j.idx``: the
bytes ``TDMKEF1\\n``, a JSON header with the sections' sizes, then doc ids
(64-bit, with a null map), the coded boundaries' upper bits, low bits and
select samples. Parts follow each other in ascending doc_id order; where a
part's ids start in the whole is the sum of those before it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.llm.eliasfano import Offsets, encode
from tidemark.llm.files import each_item, reading, writing
from tidemark.llm.wordcache import shared
from tidemark.storage import new_path

MAGIC, AT_ONCE, BLOCK_IDS = b"TDMKEF1\n", 1024, 1 << 22
#: A part ends after so many documents or ids.
MOST_DOCS, MOST_IDS = 1 << 18, 1 << 26


def write_index(uri: str, ids: list[int | None], lengths: list[int], dtype: str) -> None:
    code = encode(np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]))
    doc_ids = np.array([x or 0 for x in ids], dtype="<i8")
    null = np.packbits(np.array([x is None for x in ids], dtype=np.uint8), bitorder="little")
    sections = [("doc_ids", doc_ids), ("null", null), *((k, code[k]) for k in ("upper", "low", "samples"))]
    head = json.dumps({"dtype": dtype, "n_docs": len(ids), "n": code["n"], "low_bits": code["low_bits"], "sections": [[k, a.dtype.str, len(a)] for k, a in sections]}).encode()
    with writing(uri) as out:
        out.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for _, a in sections:
            out.write(a.tobytes())


def read_index(uri: str) -> tuple[dict, dict[str, np.ndarray], Offsets]:
    with reading(uri) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{uri} is no index of token ids")
        head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
        part = {k: np.frombuffer(f.read(n * np.dtype(t).itemsize), dtype=t) for k, t, n in head["sections"]}
    return head, part, Offsets(head["n"], head["low_bits"], part["upper"], part["low"], part["samples"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> list[dict]:
    """Encode and write all docs below folder, a URI; returns the parts in order, with path, n_docs, n_tokens and base.

    A null text is like an empty one: the end id alone. Null ids come first;
    rows of one id follow each other in the order of their texts' hashes, so
    even one id's rows may lie in several parts. Other columns are ignored. An
    empty table writes no part. Texts are range-partitioned, never gathered; a
    task begins a new part after MOST_DOCS documents or MOST_IDS ids, so what
    it holds, a slice of texts and a part's document lengths, is bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, cache = TaskContext.get().partitionId(), shared(tokenizer)
        wide = cache.width == 4 or end_id >> 16 > 0
        dtype, end = ("<u4", end_id.to_bytes(4, "little")) if wide else ("<u2", end_id.to_bytes(2, "little"))
        item, made = len(end), []

        def encoded():
            for got, texts in slices(batches):
                for i, b in zip(got, cache.ids(texts)):
                    yield i, b if cache.width == item else np.frombuffer(b, dtype=cache.dtype).astype(dtype).tobytes()

        rows = encoded()
        row = next(rows, None)
        while row is not None:
            base, ids, lengths, total = f"{folder}/part-{k:06d}-{len(made):04d}", [], [], 0
            with writing(f"{base}.ids") as out:
                while row is not None and len(ids) < MOST_DOCS and total < MOST_IDS:
                    out.write(row[1])
                    out.write(end)
                    ids.append(row[0])
                    lengths.append(len(row[1]) // item + 1)
                    total += lengths[-1]
                    row = next(rows, None)
            write_index(f"{base}.idx", ids, lengths, dtype)
            made.append((base, len(ids), total))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))], names=["path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    spread = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    parts = spread.sortWithinPartitions(*order).mapInArrow(run, "path string, n_docs long, n_tokens long").collect()
    out, base = [], 0
    for p in sorted(parts):
        out.append(p.asDict() | {"base": base})
        base += p.n_tokens
    return out


def read_tokens(spark, parts: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; one task a part.

    Ids are read and widened a block of documents at once; a block of more
    than BLOCK_IDS ids is read document by document, in pieces.
    """
    def run(part: dict) -> Iterator[pa.RecordBatch]:
        path, base = part["path"], part["base"]
        head, held, offsets = read_index(f"{path}.idx")
        null = np.unpackbits(held["null"], bitorder="little").astype(bool)
        kind = np.dtype(head["dtype"])
        with reading(f"{path}.ids") as f:
            def wide(n: int) -> bytes:
                b = f.read(n * kind.itemsize)
                return b if kind.itemsize == 4 else np.frombuffer(b, dtype=kind).astype("<u4").tobytes()

            for i in range(0, head["n_docs"], AT_ONCE):
                n = min(AT_ONCE, head["n_docs"] - i)
                at = offsets.get(i, n + 1)
                f.seek(int(at[0]) * kind.itemsize)
                places, crc = at.tolist(), []
                if places[-1] - places[0] <= BLOCK_IDS:
                    block = memoryview(wide(places[-1] - places[0]))
                    crc = [zlib.crc32(block[4 * (a - places[0]):4 * (z - places[0])]) for a, z in zip(places, places[1:])]
                else:
                    for a, z in zip(places, places[1:]):
                        c = 0
                        for k in range(a, z, BLOCK_IDS):
                            c = zlib.crc32(wide(min(BLOCK_IDS, z - k)), c)
                        crc.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(held["doc_ids"][i:i + n], mask=null[i:i + n]), pa.array(at[:-1] + base), pa.array(at[1:] - at[:-1]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return each_item(spark, parts, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, as read back from files written in the shared folder."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, end_id, new_path(spark, "tokens")))
