"""Mixing sources to target weights with DataFrame functions only.

Words are summed per source, the mix's words are shared out by weight with no source above `ceiling`
times its own (the excess goes to the others by weight), and each document is emitted floor(rate)
times plus once more with the fraction as probability, decided by a hash of its id. The sources'
totals are the only rows that meet in one place; they are partly summed before that.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; sources
without words have target 0; repeated rows take the same decision; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, body, small, stash, unused

WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame) -> Column:
    return F.size(F.array_remove(F.split(body(), SPACE), "")).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size) with target: shares by weight, none above ceiling times its source's size.

    Sources in the order of ceiling per weight stop first. With the first k stopped, the others take one level
    per weight; the answer is the first k whose level stays below the next source's ceiling.
    """
    line = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("ratio", "rank")
    every = W.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(line) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", ceiling * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    run = capped.select(
        "source", "source_size", "weight", "cap", "ratio",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
        (share * F.sum("source_size").over(every)).alias("whole"),
    )
    # the level with the sources before this one stopped; it holds from the first source whose ceiling isn't reached
    level = run.withColumn("level", (F.col("whole") - F.col("spent")) / F.col("rest"))
    found = level.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every))
    return found.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at.level") * F.col("weight"))).alias("target"))


def chance(seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of doc_id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document."""
    sized = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), sizes(docs).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = small(stash(targets(totals, weights, share, ceiling), "targets").withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(chance(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: int = 0) -> DataFrame:
    """docs with every document as many times as the mix takes it; columns are those of docs."""
    sized = docs.select(F.col("source").cast("string").alias("source"), sizes(docs).alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stash(targets(totals, weights, share, ceiling), "targets")
    key, rate, many, copy = unused(docs, "key", "rate", "many", "copy")
    rates = goal.select(F.col("source").alias(key), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    joined = docs.join(small(rates), F.col("source").cast("string").eqNullSafe(F.col(key)))
    r = F.col(rate)
    copies = F.floor(r) + F.when(chance(seed) < r - F.floor(r), 1).otherwise(0)
    taken = joined.withColumn(many, copies.cast("int")).where(F.col(many) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)), cap) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS chance
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
