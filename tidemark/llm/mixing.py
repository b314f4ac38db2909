"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight and a schedule, the rate 1 + tilt * (2 t - 1) over
training time t in [0, 1]. Its integral, scaled to the source's target words,
is the source's cumulative demand. The source's documents lie one after the
other on its word axis, in the order of a hash of their ids, and again from
the axis' start for a second pass; where a document starts on the axis, the
inverse of the demand gives its training position. Documents are sorted by
position with a range exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize

WEIGHTS, TILTS, SHARE, MOST_REPEATS = (5, 2, 1), (-0.5, 0.0, 0.5), 1.5, 2
#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, tilts=TILTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, tilt, target) from rows (source, size).

    Sources by code point with null last get the weights in turn: they are
    range-sorted, numbered within their partition, and the partitions' sizes,
    which reach the driver, are added. Targets fill like water: the level is
    shared by weight among the sources below ``repeats`` times their size, and
    falls to sums over all sources, one aggregation a round, until no further
    source is above its limit.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sorted_ = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    per = materialize(sorted_.withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    ahead, n = [], 0
    for r in sorted(per.groupBy(F.shiftright("place", 33).alias("part")).count().collect()):
        ahead.append((r.part, n))
        n += r["count"]
    firsts = spark.createDataFrame(ahead, "part long, first long")  # one row a partition
    per = per.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(firsts), "part")
    turn = F.pmod(F.col("first") + F.col("place") - F.shiftleft("part", 33), F.lit(len(weights))).cast("int")
    per = (per.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
           .withColumn("tilt", F.element_at(F.array(*map(F.lit, tilts)), F.col("turn") % len(tilts) + 1)).withColumn("cap", F.lit(repeats) * F.col("source_size"))
           .select("source", "source_size", "weight", "tilt", "cap"))
    per = materialize(per, "mix-weights")
    total = per.agg(F.sum("source_size").alias("n")).first().n or 0
    ratio, level, before = F.col("cap") / F.col("weight"), None, -1
    while True:
        under = F.lit(False) if level is None else ratio <= F.lit(level)
        got = per.agg(F.sum(F.when(under, F.col("cap"))).alias("full"), F.sum(F.when(~under, F.col("weight"))).alias("left"), F.count(F.when(under, 1)).alias("n")).first()
        if got.n == before or not got.left:
            break
        before, level = got.n, (share * total - (got.full or 0)) / got.left
    fixed = F.lit(None).cast("double") if level is None or not got.left else F.lit(level)
    target = F.coalesce(F.least(F.col("cap").cast("double"), fixed * F.col("weight")), F.col("cap").cast("double"))
    return per.select("source", "source_size", "weight", "tilt", target.alias("target"))


def position(offset: Column, target: Column, tilt: Column) -> Column:
    """Training time at which the demand reaches offset words: the inverse of target * ((1 - tilt) t + tilt t^2)."""
    y = offset / target
    return F.when(tilt == 0, y).otherwise((F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y) - (1 - tilt)) / (2 * tilt))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per input row, range-sorted by first position.

    (doc_id, source, size, source_size, target, taken, first_position,
    second_position): taken is how many words the mix takes, the second pass
    included, so that a source's taken words sum to its target, rounded down;
    only the document at the end of a source's demand is taken in part. A
    position is null where that pass does not reach the document.

    Nulls: a null text has size 0, a null source is a source, a null id is
    hashed as an empty one. Rows that share an id are taken in the order of
    their sizes; equal rows are alike. Words are counted over whole texts.
    Other columns are ignored. An empty table gives an empty result. A
    source's rows are dealt out over the square root of their number of hash
    ranges, so that no task sums a whole source.
    """
    if repeats != 2:
        raise ValueError("positions are given for two passes")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    ranges = max(1, math.isqrt(rows.count()))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("digest", digest).withColumn("range", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(rows.select("source", "size"), share, repeats=repeats)
    ranged = (sums.withColumn("ahead", ahead).alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
              .select(F.col("r.source").alias("rsource"), F.col("range").alias("rrange"), "ahead", "source_size", "tilt", "target"))
    within = Window.partitionBy("source", "range").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("upto", F.sum("size").over(within)).join(ranged, F.col("source").eqNullSafe(F.col("rsource")) & (F.col("range") == F.col("rrange")))
              .withColumn("at", F.col("ahead") + F.col("upto") - F.col("size")))
    demand = F.floor("target").cast("long")
    again = F.col("at") + F.col("source_size")

    def overlap(start: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), demand - start))

    def when(start: Column) -> Column:
        return F.when(start < demand, position(start.cast("double"), F.col("target"), F.col("tilt")))

    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (overlap(F.col("at")) + overlap(again)).cast("long").alias("taken"),
        when(F.col("at")).alias("first_position"), when(again).alias("second_position"), "digest",
    ).orderBy(F.col("first_position").asc_nulls_last(), "digest", "size").drop("digest")  # rows that are not reached are dealt out by digest


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each pass that reaches a document, sorted by position.

    Whole passes repeat the whole row. Where a source's demand ends inside a
    document, that pass takes the document whole if the demand covers half of
    its words, else not: texts are never cut. Documents without words go.
    Rows that share an id are treated alike, by the words their id's rows take
    together. Columns are those of docs.
    """
    taken = (schedule(docs, id_col, text_col, source_col).where("size > 0").groupBy("doc_id")
             .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("first_position").alias("p1"), F.min("second_position").alias("p2"))
             .select(F.col("doc_id").alias("__id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__copies"), F.slice(F.array(F.coalesce("p1", F.lit(1.0)), F.coalesce("p2", F.lit(1.0))), 1, F.round(F.col("taken") / F.col("size")).cast("int")).alias("__at"))
             .where("__copies > 0"))
    repeated = docs.join(taken, F.col(id_col).eqNullSafe(F.col("__id"))).withColumn("__position", F.explode("__at"))
    return repeated.repartitionByRange(F.col("__position")).sortWithinPartitions("__position", id_col).select(*docs.columns)


def op2_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position, second_position."""
    return schedule(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position", "second_position")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[turn + 1] AS weight, ([-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE])[turn + 1] AS tilt, 2 * source_size AS cap FROM per
), rising AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST) AS place FROM weighed
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM rising
), fixed AS (
  SELECT arg_min(level, place) AS fixed FROM levels WHERE cap::DOUBLE / weight > level
), targets AS (
  SELECT source, source_size, tilt, coalesce(least(cap::DOUBLE, fixed * weight), cap::DOUBLE) AS target FROM levels LEFT JOIN fixed ON TRUE
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt, floor(t.target)::BIGINT AS demand,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS begins
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, demand - begins)) + greatest(0, least(size, demand - (begins + source_size))))::BIGINT AS taken,
  CASE WHEN begins < demand THEN CASE WHEN tilt = 0 THEN begins::DOUBLE / target ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (begins::DOUBLE / target)) - (1 - tilt)) / (2 * tilt) END END AS first_position,
  CASE WHEN begins + source_size < demand THEN CASE WHEN tilt = 0 THEN (begins + source_size)::DOUBLE / target ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ((begins + source_size)::DOUBLE / target)) - (1 - tilt)) / (2 * tilt) END END AS second_position
FROM placed
"""
