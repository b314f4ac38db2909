"""Embedding near-duplicates with a forest of random-projection trees with spill overlap.

A tree splits a label's vectors again and again by their projection on a random
direction. Of a few directions and cuts the one with the fewest vectors near it
is taken, and vectors nearer to it than the spill go to both sides. A node where
no cut leaves out enough pairs stays whole, of whatever size. Splits are learned
from bounded samples of a node, in rounds; what a round gives each vector is the
list of its leaves' keys.

No link is lost, whatever the sizes. The trees draw their directions from
subspaces at right angles to each other, one a tree. Unit vectors that link are
at most d = sqrt(2 - 2 * threshold) apart, and the squares of their distances
within the subspaces of m trees sum to d * d at most; so in one of them they
are within d / sqrt(m). The spill is half of that: no cut of that tree parts
them. Samples and sizes only decide how much is compared.

In a leaf all vectors are compared, in double precision. A pair may share
several leaves; it is counted in the one with the smallest key, which each
task can tell from the two lists, so counts are those of distinct links.

A node whose vectors mostly lie within half the threshold angle of its centre
is a dense group: those vectors all link with each other, so they are a ball
and are counted, not paired; only the others are compared with them. A leaf too
large for a task is compared in blocks, a pair of blocks a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.storage import drop, materialize

THRESHOLD, TREES, LEAF, SAMPLE, MAX_DEPTH, ROUNDS, TRIES = 0.98, 6, 1024, 2000, 8, 12, 12
#: Directions of all trees together; rows of a block; bytes of split tables that one pass broadcasts.
POOL, BLOCK, TABLE_BYTES = 2048, 4096, 64 << 20
#: Share of a node's pairs that the sides of a cut may hold together; rows of keys up to which a join is hinted as a broadcast.
PAIRS, FEW_KEYS = 0.85, 500_000
_SPLIT = np.dtype([("dir", "<i4"), ("low", "<i4"), ("high", "<i4"), ("cut", "<f8"), ("spill", "<f8")])


@lru_cache(maxsize=4)
def directions(dims: int, trees: int) -> list[np.ndarray]:
    """Unit directions of each tree, as rows; those of different trees are at right angles. There are no more trees than dimensions."""
    rng, m = np.random.default_rng([dims, 7]), min(trees, dims)
    out = []
    for basis in np.array_split(np.linalg.qr(rng.standard_normal((dims, dims)))[0].T, m):
        d = rng.standard_normal((max(1, POOL // m), len(basis))) @ basis
        out.append(d / np.sqrt((d * d).sum(axis=1, keepdims=True)))
    return out


def spill_of(threshold: float, trees: int, dims: int) -> float:
    """The least spill with which some tree keeps each two linked vectors together, and a margin for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold) / min(trees, dims)) / 2 + 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def key_of(parent: int, path: str, trees: int) -> int:
    """An even 62-bit key, of the parent's tree t: 2 * t modulo 2 * trees. Odd keys are of leaves that are not split again."""
    h = int.from_bytes(blake2b(repr((parent, path)).encode(), digest_size=8).digest(), "little") >> 2
    return h - h % (2 * trees) + parent % (2 * trees)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, distinct): rows (vec_id, h1, h2), null hashes for what links with nothing; distinct (cls, node, n, v, h1, h2).

    Vectors equal in every component, of one label, are one class, named by
    its smallest id; they are told apart by 128 bits of hash. A node is a label
    and a number of dimensions.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & (F.array_max(F.transform(v, F.abs)) > 0), F.lit(False))
    hashes = [F.when(ok, F.xxhash64("label", "v")).alias("h1"), F.when(ok, F.xxhash64(F.lit(5), "v", "label")).alias("h2")]
    own = rows.select("vec_id", *hashes)
    node = F.concat_ws("|", F.hex(F.col("label").cast("binary")), F.size("v").cast("string"))
    some = rows.where(ok).select(*hashes, "vec_id", node.alias("node"), "v").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "node", "v")).alias("f"), F.count("*").alias("n"))
    return own, materialize(some.select(F.col("f.vec_id").alias("cls"), "f.node", "n", "f.v", "h1", "h2"), "forest-classes")


def grow(x: np.ndarray, depth: int, rng: np.random.Generator, pool: np.ndarray, spill: float) -> list[tuple]:
    """A subtree from a sample of unit vectors as rows (dir, low, high, cut, spill), the root first; a child of -1 is a leaf."""
    out: list[tuple] = []

    def add(x: np.ndarray, depth: int) -> int:
        if depth <= 0 or len(x) < 16:
            return -1
        best = None
        for k in rng.integers(0, len(pool), TRIES).tolist():
            p = x @ pool[k]
            for q in (0.5, 0.35, 0.65, 0.2, 0.8, 0.08, 0.92):
                cut = float(np.quantile(p, q))
                near, left = np.mean(np.abs(p - cut) <= spill), np.mean(p <= cut)
                cost = near + abs(left - 0.5) / 2
                if np.mean(p <= cut + spill) ** 2 + np.mean(p > cut - spill) ** 2 <= PAIRS and (best is None or cost < best[0]):
                    best = (cost, k, cut, p)
        if best is None:
            return -1
        _, k, cut, p = best
        i = len(out)
        out.append(())
        out[i] = (k, add(x[p <= cut + spill], depth - 1), add(x[p > cut - spill], depth - 1), cut, spill)
        return i

    add(x, depth)
    return out


def route(x: np.ndarray, table: np.ndarray, pool: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(path, rows) of each leaf; rows near a cut are in both of its sides."""
    out, todo = [], [("", 0 if len(table) else -1, np.arange(len(x)))]
    while todo:
        path, node, rows = todo.pop()
        if node < 0:
            out.append((path, rows))
            continue
        t = table[node]
        p = x[rows] @ pool[t["dir"]]
        todo += [(path + "l", int(t["low"]), rows[p <= t["cut"] + t["spill"]]), (path + "h", int(t["high"]), rows[p > t["cut"] - t["spill"]])]
    return out


def _learn(leaf: int, threshold: float, trees: int):
    def learn(group: pd.DataFrame) -> pd.DataFrame:
        key, size = int(group["key"].iloc[0]), int(group["size"].iloc[0])
        x = unit(np.array(group.sort_values("cls")["v"].tolist()))
        centre = x.mean(axis=0)
        centre /= max(np.sqrt(centre @ centre), 1e-300)
        if np.mean(x @ centre >= math.cos(math.acos(threshold) / 2) + 1e-9) >= 0.5:
            return pd.DataFrame([(key, b"", centre.tobytes())], columns=["key", "splits", "centre"])
        depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(size / leaf))))
        pool = directions(x.shape[1], trees)[key % (2 * trees) // 2]
        table = np.array(grow(x, depth, np.random.default_rng(key), pool, spill_of(threshold, trees, x.shape[1])), dtype=_SPLIT)
        return pd.DataFrame([(key, table.tobytes(), b"")], columns=["key", "splits", "centre"])

    return learn


def _rows(column: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """The lists at the rows, all of one length, as a matrix."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _by_length(column: pa.ListArray) -> Iterator[np.ndarray]:
    n = np.diff(column.offsets.to_numpy())
    for k in np.unique(n):
        yield np.flatnonzero(n == k)


def _divide(tables: dict[int, tuple[np.ndarray, np.ndarray | None]], threshold: float, trees: int, first: bool):
    """Routes each vector within those of its leaves that have a table; a leaf without splits becomes odd, and its centre's ball is noted.

    Where a root has no splits, in the first round, its label is one leaf for
    all trees, with one centre: that of the first tree with one.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    end = {k: k - k % (2 * trees) + 1 if first else k | 1 for k in sorted(tables)}
    whole = {end[k] for k in tables if not len(tables[k][0])}
    ends = {k: last for k, last in end.items() if last in whole}
    centres: dict[int, np.ndarray] = {}
    for k, last in ends.items():
        if tables[k][1] is not None:
            centres.setdefault(last, tables[k][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, str], int] = {}
        for batch in batches:
            leaves, ball = batch["leaves"].to_pylist(), batch["ball"].to_pylist()
            todo: dict[int, list[int]] = {}
            for i, own in enumerate(leaves):
                for k in own:
                    if k in tables:
                        todo.setdefault(k, []).append(i)
            for rows in _by_length(batch["v"]):
                x, place = unit(_rows(batch["v"], rows)), {int(r): j for j, r in enumerate(rows.tolist())}
                pools = directions(x.shape[1], trees) if todo else []
                for k, some in todo.items():
                    some = [i for i in some if i in place]
                    if not some:
                        continue
                    table = tables[k][0]
                    own = x[[place[i] for i in some]]
                    if k in ends:
                        last = ends[k]
                        inside = own @ centres[last] >= half if last in centres else np.zeros(len(own), bool)
                        for i, b in zip(some, inside.tolist()):
                            leaves[i].remove(k)
                            if last not in leaves[i]:
                                leaves[i].append(last)
                            if b and ball[i] is None:
                                ball[i] = last
                        continue
                    for i in some:
                        leaves[i].remove(k)
                    for path, at in route(own, table, pools[k % (2 * trees) // 2]):
                        new = names.setdefault((k, path), 0) or names.update({(k, path): key_of(k, path, trees)}) or names[(k, path)]
                        for j in at.tolist():
                            leaves[some[j]].append(new)
            cols = {c: batch[c] for c in ("cls", "n", "v")}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(leaves, pa.list_(pa.int64())), pa.array(ball, pa.int64())], names=[*cols, "leaves", "ball"])

    return run


def _few(keys: DataFrame) -> DataFrame:
    """A stored table of keys, hinted as a broadcast if it is small; else joins are left to the optimizer."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def forest(distinct: DataFrame, trees: int, leaf: int, threshold: float) -> DataFrame:
    """(cls, n, v, leaves, ball): keys of each vector's leaves, and its ball if it lies in a dense group.

    Vectors are never shuffled but for the samples; a round rewrites the table
    and drops the one before. Tables of splits are 28 bytes a split, and are
    broadcast TABLE_BYTES at a time.
    """
    kind = distinct.schema["v"].dataType.simpleString()
    schema = f"cls long, n long, v {kind}, leaves array<bigint>, ball long"
    sizes = distinct.groupBy("node").agg(F.count("*").alias("size"))
    h = F.shiftrightunsigned(F.xxhash64("node", F.lit(3)), 2)
    hashed = lambda t: h - h % F.lit(2 * trees) + F.lit(t)
    own = F.slice(F.array(*[hashed(2 * t) for t in range(trees)]), F.lit(1), F.least(F.lit(trees), F.size("v")))
    roots = F.when(F.col("size") > leaf, own).otherwise(F.array(hashed(1)))
    state = materialize(distinct.join(sizes, "node").select("cls", "n", "v", roots.alias("leaves"), F.lit(None).cast("long").alias("ball")), "forest-state")
    for turn in range(ROUNDS):
        aim = max(leaf, BLOCK // 2) if turn else leaf  # later rounds leave what fits a block, as copies cost more than pairs
        keys = state.select(F.explode("leaves").alias("key")).where(F.col("key") % 2 == 0).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > (2 * aim if turn else leaf))
        large = materialize(keys, "forest-large")
        if large.isEmpty():
            drop(large)
            break
        place = F.shiftrightunsigned(F.xxhash64("cls", "key", F.lit(turn)), 12) / F.lit(2.0**52)
        want = F.greatest(F.lit(256), F.least(F.lit(SAMPLE), F.floor(F.col("size") / 4)))
        some = state.select("cls", "v", F.explode("leaves").alias("key")).where(F.col("key") % 2 == 0).join(_few(large), "key").withColumn("place", place).where(F.col("place") < 1.3 * want / F.col("size"))
        few = some.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("place", "cls"))).where(F.col("k") <= SAMPLE).select("key", "cls", "v", "size")
        plan = materialize(few.groupBy("key").applyInPandas(_learn(aim, threshold, trees), "key long, splits binary, centre binary"), "forest-splits")
        total = plan.agg(F.sum(F.length("splits") + F.length("centre") + 64).alias("b")).first().b
        passes = max(1, math.ceil(total / TABLE_BYTES))
        for k in range(passes):
            label = F.col("key") - F.col("key") % (2 * trees)  # all roots of a label are of one pass
            got = plan.where(F.pmod(F.xxhash64(label), F.lit(passes)) == k).collect()
            tables = {r.key: (np.frombuffer(bytes(r.splits), dtype=_SPLIT), np.frombuffer(bytes(r.centre)) if r.centre else None) for r in got}
            held = state.sparkSession.sparkContext.broadcast(tables)
            new = materialize(state.mapInArrow(lambda b, h=held, first=turn == 0: _divide(h.value, threshold, trees, first)(b), schema), "forest-state")
            drop(state)
            state = new
        drop(large)
        drop(plan)
    return state


def owned(own: np.ndarray, leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share no leaf with a key smaller than ``own``; leaves: a row each, padded with -1."""
    out = np.empty(len(i), dtype=bool)
    step = max(1, 8_000_000 // leaves.shape[1] ** 2)
    for at in range(0, len(i), step):
        a, b = leaves[i[at:at + step]], leaves[j[at:at + step]]
        out[at:at + step] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0) & (a[:, :, None] < own)).any(axis=(1, 2))
    return out


def links_in_leaf(key: int, x: np.ndarray, weight: np.ndarray, leaves: np.ndarray, ball: np.ndarray, side: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(links, root): summed weights of the other vectors each links with in this unit, and the least index reachable in it.

    side 0 is compared with all of side 0 and 1, side 1 with side 0 only, side
    2 with side 3 only. Pairs of one ball, and pairs that a smaller key owns,
    are not counted.
    """
    m = len(x)
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)

    left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero(side != 2)
    for at in range(0, len(left), 256):
        a = left[at:at + 256]
        for lo in range(0, len(right), 1024):
            b = right[lo:lo + 1024]
            if b[-1] <= a[0] and not side[a].any() and not side[b].any():
                continue  # pairs of side 0 that are met the other way round
            hit = x[a] @ x[b].T >= threshold
            if not hit.any():
                continue
            hit &= (ball[a][:, None] != ball[b][None, :]) | (ball[a][:, None] < 0)
            hit &= (side[a][:, None] != 0) | (side[b][None, :] != 0) | (a[:, None] < b[None, :])  # a pair of side 0 once
            i, j = np.nonzero(hit)
            i, j = a[i], b[j]
            if not len(i):
                continue
            ok = owned(key, leaves, i, j)
            i, j = i[ok], j[ok]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            while len(i):  # each root with a link to a smaller one is hung below it, until no link is between two roots
                p, q = root[i], root[j]
                i, j = i[p != q], j[p != q]
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while (root[root] != root).any():
                    root = root[root]
    return links, root


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, key, side, cls, n, v, leaves, ball) sorted by unit in; (cls, links, root class) of members with links out."""
    def solve(parts: list[tuple]) -> pa.RecordBatch | None:
        key, side, cls, n, ball = (np.concatenate([p[i] for p in parts]) for i in range(5))
        if len(cls) < 2:
            return None
        x = unit(np.concatenate([p[5] for p in parts]))
        width = max(p[6].shape[1] for p in parts)
        leaves = np.concatenate([np.pad(p[6], ((0, 0), (0, width - p[6].shape[1])), constant_values=-1) for p in parts])
        order = np.argsort(cls, kind="stable")
        links, root = links_in_leaf(int(key[0]), x[order], n[order], leaves[order], ball[order], side[order], threshold)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[order][some]), pa.array(links[some]), pa.array(cls[order][root][some])], names=["cls", "links", "root"]) if some.any() else None

    last, held = None, []
    for batch in batches:
        units = batch["unit"].to_numpy()
        ends = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)] if len(units) else [0]
        for a, z in zip(ends, ends[1:]):
            if units[a] != last and held:
                if (got := solve(held)) is not None:
                    yield got
                held = []
            last = units[a]
            some = batch.slice(a, z - a)
            count = some["leaves"].value_lengths().to_numpy()
            leaves = np.full((len(count), max(1, int(count.max()))), -1, dtype=np.int64)
            leaves[np.arange(leaves.shape[1])[None, :] < count[:, None]] = some["leaves"].flatten().to_numpy()
            held.append((*[some[c].to_numpy(zero_copy_only=False) for c in ("key", "side", "cls", "n", "ball")], _rows(some["v"], np.arange(z - a)), leaves))
    if held and (got := solve(held)) is not None:
        yield got


def units(state: DataFrame) -> DataFrame:
    """(unit, key, side, cls, n, v, leaves, ball): what is compared together; leaves are those with smaller keys.

    A leaf of BLOCK vectors or fewer is a unit. A larger one is dealt into
    blocks by hash, those outside its ball (a) and those in it (c): units are
    an a-block with itself, each two a-blocks, and each a-block with each
    c-block; a ball alone is no unit.
    """
    each = state.select("*", F.explode("leaves").alias("key")).withColumn("core", F.coalesce(F.col("ball") == F.col("key"), F.lit(False)))
    sizes = each.groupBy("key").agg(F.count("*").alias("all"), F.count(F.when(~F.col("core"), 1)).alias("free")).where(F.col("all") > BLOCK)
    large = materialize(sizes.select("key", F.ceil(F.col("free") / BLOCK).cast("int").alias("a"), F.ceil((F.col("all") - F.col("free")) / BLOCK).cast("int").alias("c")), "forest-large")
    rows = each.join(_few(large), "key", "left")
    i = F.pmod(F.xxhash64("cls", F.lit(3)), F.greatest(F.when(F.col("core"), F.col("c")).otherwise(F.col("a")), F.lit(1))).cast("int")
    seq = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n), f)
    place = lambda p, q, kind, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    other = seq(F.col("a"), lambda k: place(F.least(F.col("i"), k), F.greatest(F.col("i"), k), 0, F.when(k == F.col("i"), 0).when(F.col("i") < k, 2).otherwise(3)))
    with_core = seq(F.col("c"), lambda k: place(F.col("i"), k, 1, F.lit(2)))
    cores = seq(F.col("a"), lambda k: place(k, F.col("i"), 1, F.lit(3)))
    whole = F.array(place(F.lit(0), F.lit(0), 0, F.when(F.col("core"), 1).otherwise(0)))
    rows = rows.withColumn("i", i).withColumn("u", F.explode(F.when(F.col("a").isNull(), whole).when(F.col("core"), cores).otherwise(F.concat(other, with_core))))
    return rows.select(F.xxhash64("key", "u.p", "u.q", "u.kind").alias("unit"), "key", F.col("u.side").alias("side"), "cls", "n", "v", F.filter("leaves", lambda k: k < F.col("key")).alias("leaves"), F.coalesce("ball", F.lit(-1)).alias("ball"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least threshold. All links are found, in tables
    of any size, and none below it is made; a node that no cut serves is
    compared all with all, in blocks.
    n_links counts each linked vector once, in however many leaves it is met.
    Null vectors and labels, vectors of zeros or with null or non-finite
    components link with nothing; vectors of different lengths do not link.
    Equal vectors are counted without being paired. A null id links with
    nothing; rows that share an id are vectors of their own and are counted,
    and the id's row gets its own vector's count. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows, distinct = classes(vectors, id_col, vector_col, label_col)
    # two classes can be named alike only if an id stands for several vectors; the class is then named by its hash
    named = distinct.select(F.col("cls").alias("least"), "node", "n", "v", "h1", "h2").withColumn("cls", F.col("h1"))
    state = forest(named.select("cls", "node", "n", "v"), trees, leaf, threshold)
    dealt = units(state).repartition("unit").sortWithinPartitions("unit")
    found = materialize(dealt.mapInArrow(lambda b: _compare(b, threshold), "cls long, links long, root long"), "forest-links")
    balls = state.where("ball is not null").groupBy("ball").agg(F.min("cls").alias("first"), F.sum("n").alias("total"))
    inside = materialize(state.where("ball is not null").select("cls", "n", "ball").join(balls, "ball").select("cls", (F.col("total") - F.col("n")).alias("links"), F.col("first").alias("root")), "forest-balls")
    every = found.unionByName(inside)
    edges = every.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
    component = connected_components(edges).withColumnRenamed("node", "cls")
    links = every.groupBy("cls").agg(F.sum("links").alias("links"))
    known = (named.select("cls", "least", "n", "h1", "h2").join(links, "cls", "left").join(component, "cls", "left")
             .select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")))
    known = materialize(known, "forest-known")
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("h1", "h2", "n_links", "component_id")
    out = rows.where("h1 is not null").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors)
