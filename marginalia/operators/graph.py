"""The link graph: resolving links, backlinks, broken links and orphans, all by equi-joins.

A target with `/` must be a note's whole path; another target resolves only if exactly one note has that
stem. Keys are compared as functions.paths.link_key makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(parsed: DataFrame) -> DataFrame:
    """(source, raw, target, line, key, by_path) of every link, empty targets included."""
    flat = parsed.select(F.col("path").alias("source"), F.explode("links").alias("l"))
    return flat.select("source", F.col("l.raw").alias("raw"), F.col("l.target").alias("target"), F.col("l.alias").alias("alias"), F.col("l.line").alias("line"), F.col("l.key").alias("key"), F.contains("l.key", F.lit("/")).alias("by_path"))


def resolver(parsed: DataFrame) -> DataFrame:
    """(key, by_path, resolved): where each unambiguous key leads; paths that fold to one key give the smallest."""
    whole = parsed.groupBy(F.col("path_key").alias("key")).agg(F.min("path").alias("resolved")).select("key", F.lit(True).alias("by_path"), "resolved")
    stems = parsed.groupBy(F.col("stem_key").alias("key")).agg(F.min("path").alias("resolved"), F.count("*").alias("n")).where("n = 1").select("key", F.lit(False).alias("by_path"), "resolved")
    return whole.unionByName(stems)


def candidates(parsed: DataFrame) -> DataFrame:
    """(stem_key, path) of the stems that several notes share."""
    many = parsed.groupBy("stem_key").agg(F.count("*").alias("n")).where("n > 1")
    return parsed.join(many, "stem_key", "left_semi").select("stem_key", "path")


def resolved(parsed: DataFrame) -> DataFrame:
    """Every link with the note it leads to, or null."""
    return links(parsed).join(resolver(parsed), ["key", "by_path"], "left").select("source", "raw", "target", "alias", "line", "resolved")


def edges(found: DataFrame) -> DataFrame:
    """Distinct (target, source) of resolved links; empty targets lead nowhere."""
    return found.where(F.col("resolved").isNotNull() & (F.col("target") != "")).select(F.col("resolved").alias("target"), "source").distinct()


def backlinks(found: DataFrame, path: str) -> DataFrame:
    """Notes that link to path, with the raw text and line of each link."""
    own = found.where((F.col("resolved") == path) & (F.col("target") != ""))
    return own.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("refs"))


def outgoing(found: DataFrame, path: str) -> DataFrame:
    return found.where(F.col("source") == path).select("raw", "target", "line", "resolved")


def broken(found: DataFrame) -> DataFrame:
    """Links that lead to no note or to several; empty targets aren't links."""
    return found.where(F.col("resolved").isNull() & (F.col("target") != "")).select("source", "raw", "target", "line")


def orphans(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """Notes without backlinks that link nowhere (no_links), or only to what isn't there (broken_outgoing_only)."""
    out = found.where(F.col("target") != "").groupBy("source").agg(F.bool_or(F.col("resolved").isNotNull()).alias("reaches"), F.array_sort(F.collect_set("target")).alias("targets"))
    back = edges(found).select(F.col("target").alias("path")).distinct()
    alone = parsed.select("path").join(back, "path", "left_anti").join(out, F.col("path") == F.col("source"), "left")
    kind = F.when(F.col("targets").isNull(), "no_links").when(~F.col("reaches"), "broken_outgoing_only")
    return alone.select("path", kind.alias("kind"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets")).where(F.col("kind").isNotNull())


def backlink_counts(parsed: DataFrame, found: DataFrame) -> DataFrame:
    counts = edges(found).groupBy("target").agg(F.count("*").alias("n"))
    return parsed.join(counts, F.col("path") == F.col("target"), "left").select("path", "title", "tags", F.coalesce("n", F.lit(0)).alias("backlinks"))
