"""Folders of notes, on any file system that Spark reads."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths

MAX_SOURCE_BYTES = 16 << 20


def visible(path: Column) -> Column:
    return ~F.exists(F.split(path, r"[/\\]"), lambda p: p.startswith("."))


def file_class(path: Column, rules: list[str] = ()) -> Column:
    """note, excluded (a note under an exclusion rule) or attachment."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(~name.rlike(r"(?i)^.+\.md$"), "attachment").when(excluded(path, rules), "excluded").otherwise("note")


def excluded(path: Column, rules: list[str]) -> Column:
    found = F.lit(False)
    for r in rules:
        found |= path.rlike(paths.glob_regex(r))
    return found


def inventory(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """path, class, size and modified of every visible file below root; contents aren't read."""
    top = root.rstrip("/")
    base = top.split("://", 1)[-1] if "://" in top else os.path.abspath(top)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).select("path", "modificationTime", "length")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + _quoted(base) + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(visible(F.col("path"))).withColumn("class", file_class(F.col("path"), rules))


def notes(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """path, content, size and modified of the notes below root; larger ones than MAX_SOURCE_BYTES aren't taken (see oversized)."""
    top = root.rstrip("/")
    base = top.split("://", 1)[-1] if "://" in top else os.path.abspath(top)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).where(F.col("length") <= MAX_SOURCE_BYTES)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + _quoted(base) + "/", "")
    found = files.select(relative.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(visible(F.col("path")) & (file_class(F.col("path"), rules) == "note"))


def oversized(found: DataFrame) -> DataFrame:
    """(path, error) of the notes of an inventory that are too large to be taken."""
    return found.where((F.col("class") == "note") & (F.col("size") > MAX_SOURCE_BYTES)).select("path", F.concat(F.lit("larger than "), F.lit(str(MAX_SOURCE_BYTES)), F.lit(" bytes")).alias("error"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
