"""Mixing sources to target weights.

Tokens are summed per source, each source's repetition rate is its target over its size, and every document is emitted
floor(rate) times, plus once more with probability rate - floor(rate), by a hash of its doc_id. All of it is
DataFrame code: one aggregation by source with partial sums, windows over one row a source, and a join of that small table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.shared import written

#: A table of targets of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: The contract's weights, by rank of the source name, repeating.
WEIGHTS = (1, 2, 3)
MAX_RATE = 3


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets share the total size by weight; none exceeds max_rate times its source's size, and what is above is
    shared again by weight until none is above. The end of that process is min(cap, level * weight) for one
    level. With sources in ascending order of cap / weight, the first k are at their caps, and k is the least for which
    the level of the others doesn't reach the next cap. One row a source goes through the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    up_to = W.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * max_rate).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    t = t.withColumn("caps_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0))).withColumn("weights_before", F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
    t = t.withColumn("level", (F.col("total") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weights_before")).cast("double"))
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole))
    capped = F.col("final").isNull() | (F.struct("ratio", "rank") < F.struct(F.col("final.ratio"), F.col("final.rank")))
    return t.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("final.level") * F.col("weight")).alias("target"))


def _chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; equal for equal doc_ids, on any run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, weights: tuple[int, ...], max_rate: int, seed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names, which no column of the caller's has: size, source_size, target and copies.

    The table of targets is written and counted first. It is broadcast if it is small; otherwise the join's two sides are plain
    exchanges, so that Spark can split a hot source's documents.
    """
    size, source, total, target, copies = (f"_{uuid.uuid4().hex}" for _ in range(5))
    docs = docs.withColumn(size, size_of(F.col("text")))
    targets = source_targets(docs.select("source", F.col(size).alias("size")), weights, max_rate).select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    targets = written(targets, "targets")
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col(source)), "left").drop(source)
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total).cast("double")).otherwise(F.lit(0.0))
    extra = (_chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.floor(rate).cast("long") + extra), [size, total, target, copies]


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target and copies: how often the mix emits the document.

    Rows with a null source form a source of their own, ranked last. Repeated rows count each; rows that share
    a doc_id also share the draw. A source without words (null, empty or white texts) has target 0 and no copies. An empty table gives an
    empty one. Columns of these four names in ``docs`` are replaced; no other name matters.
    """
    names = ["size", "source_size", "target", "copies"]
    planned, own = _planned(docs.drop(*names), weights, max_rate, seed)
    return planned.withColumnsRenamed(dict(zip(own, names, strict=True)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as planned, with all its columns, and copy numbered from 1 (a column copy is replaced).

    Nulls, repeats and empty tables are as in ``plan_mix``.
    """
    docs = docs.drop("copy")
    planned, (_, _, _, copies) = _planned(docs, weights, max_rate, seed)
    return planned.where(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("copy"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``plan_mix``."""
    planned = plan_mix(docs.select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
t AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / (rank % 3 + 1)::DOUBLE AS ratio FROM s),
u AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before
  FROM t WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - caps_before)::DOUBLE / (weights - weights_before)::DOUBLE AS level FROM u),
f AS (SELECT ratio AS f_ratio, rank AS f_rank, level AS f_level FROM v WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN f_ratio IS NULL OR ratio < f_ratio OR (ratio = f_ratio AND rank < f_rank)
    THEN cap::DOUBLE ELSE f_level * weight END AS target FROM v LEFT JOIN f ON true),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::BIGINT) AS taken
FROM r
"""
