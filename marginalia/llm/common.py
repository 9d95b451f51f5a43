"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import threading
import uuid
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import remove_tree, shared_dir

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: Rows up to which a side whose size has been counted may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one key up to which a shuffle may bring them together.
HOT_ROWS = 1000


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in getattr(_scratch, "open", [])[-1:]:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


_scratch = threading.local()


@contextmanager
def scratch(spark):
    """Tables that stash() writes inside go at the end, but for those that the block hands to the function it gets.

    What is kept must not read what goes: it is a stashed table itself. It then belongs to the block around, if any.
    """
    outer = getattr(_scratch, "open", [])
    made: list[str] = []
    kept: list[str] = []
    _scratch.open = [*outer, made]

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stashed_at)
        return df

    try:
        yield keep
    finally:
        _scratch.open = outer
        for path in made:
            if path not in kept:
                remove_tree(spark, path)
        for around in outer[-1:]:
            around += kept


def discard(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    remove_tree(df.sparkSession, df.stashed_at)


def pieces(batches, rows: int = 512):
    """Arrow batches cut to a few rows each, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next stage's share of the machine is another one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to be done


def body(name: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@cache
def one_blas_thread() -> None:
    """Let numpy multiply on one thread in this process: a task has one core, and threads that wait for work burn the others'."""
    for file in sorted(Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*")):
        library = ctypes.CDLL(str(file))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def in_fold(mod: int, rest: int) -> Column:
    """True where crc32(doc_id as text) mod `mod` is `rest`; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(True))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right (key, ..., n), which has one row a key and in n at least the rows that left has of it.

    Keys with more than HOT_ROWS rows (or a 100,000th of all) are 100,000 at most; their rows of left stay where
    they are and right is broadcast to them. All others are joined by a shuffle. right should be a written table.
    """
    total, most = right.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // 100_000)
    if (most or 0) <= limit:
        return left.join(right.drop("n"), key)
    hot = F.broadcast(right.where(F.col("n") > limit).drop("n"))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") <= limit).drop("n"), key)
    return left.join(hot, key).unionByName(rest)


def sampled_labels(labels: DataFrame, label: str, bound: int, mod: int = 5) -> DataFrame:
    """At most `bound` labelled training ids with their label, chosen by hash; folds with rest 0 are left out.

    Null ids and null labels are dropped; an id labelled twice takes the larger label.
    """
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~in_fold(mod, 0))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so (columns are named without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken or f"{name.lower()}_" in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
