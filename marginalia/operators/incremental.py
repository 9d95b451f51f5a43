"""Keeping a corpus up to date: reconciling listings, coalescing changes, choosing due work, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame) -> DataFrame:
    """The newest change (largest generation) of each path."""
    return changes.groupBy("path").agg(F.max("generation").alias("generation"), F.max_by("kind", "generation").alias("kind"))


def removed(tracked: DataFrame, present: DataFrame, scan_start: int | None = None) -> DataFrame:
    """Tracked paths that a complete scan didn't see; what changed after the scan began is left alone."""
    gone = tracked.join(present.select("path"), "path", "left_anti")
    return gone.where(F.col("generation") <= scan_start).select("path") if scan_start is not None else gone.select("path")


def changed(tracked: DataFrame, present: DataFrame, full: bool = False) -> DataFrame:
    """Present paths that are new or whose size or time differs; all of them for a full check."""
    if full:
        return present.select("path")
    was = tracked.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = present.join(was, "path", "left")
    return both.where(~F.col("size").eqNullSafe(F.col("_size")) | ~F.col("modified").eqNullSafe(F.col("_modified"))).select("path")


def event_changes(events: DataFrame, present: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, kind) that events on files or folders (path; "" is the whole corpus) call for: refresh what is there, remove what isn't.

    An event on a folder concerns all that is or was below it. Files meet events on their own path and on each
    folder above it by equal paths, so a busy folder costs no more than its files.
    """
    above = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), 1, n), "/"))
    known = present.select("path", F.lit(True).alias("there")).unionByName(tracked.select("path", F.lit(False).alias("there")))
    known = known.groupBy("path").agg(F.max("there").alias("there"))
    met = known.select("path", "there", F.explode(above(F.col("path"))).alias("event")).join(events.select(F.col("path").alias("event")).distinct(), "event", "left_semi")
    return met.select("path", F.when(F.col("there"), "refresh").otherwise("remove").alias("kind")).distinct()


def reconciled(tracked: DataFrame, present: DataFrame, complete: bool, scan_start: int | None = None, full: bool = False) -> DataFrame:
    """(path, kind) of a scan: new and changed paths are refreshed; only a complete scan may remove what it didn't see."""
    found = changed(tracked, present, full).withColumn("kind", F.lit("refresh"))
    return found.unionByName(removed(tracked, present, scan_start).withColumn("kind", F.lit("remove"))) if complete else found


def projected(old: DataFrame, new: DataFrame) -> DataFrame:
    """changed, removed or same for each path of two (path, revision) tables."""
    a, b = old.select("path", F.col("revision").alias("was")), new.select("path", F.col("revision").alias("now"))
    kind = F.when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind"))


def due(work: DataFrame, now: float, batch: int) -> DataFrame:
    """The next work: removals first, then by generation, then by path; what has to wait still waits."""
    ready = work.where((F.col("kind") != "awaiting_lexical") & (F.col("not_before") <= now))
    return ready.orderBy(F.when(F.col("kind") == "remove", 0).otherwise(1), "generation", "path").limit(batch)


#: Classes of failures that are tried again; all others end the work on a note.
RETRIED = ("request_retryable", "transient_io", "storage_unavailable", "storage_remote_failure")


def after_failures(work: DataFrame, failures: DataFrame, now: float) -> DataFrame:
    """work (path, kind, generation, attempt, not_before) after failures (path, class, retry_after: seconds or null).

    What is tried again waits for its attempt's delay (doubled from one second, 30 at most) or as long as the
    provider asks, if that is longer; what isn't is marked failed. Other work stays as it is.
    """
    once = failures.groupBy(F.col("path").alias("_path")).agg(F.max_by("class", F.struct(~F.col("class").isin(*RETRIED), "class")).alias("class"), F.max("retry_after").alias("retry_after"))
    both = work.join(once, F.col("path") == F.col("_path"), "left")
    attempt = F.col("attempt") + F.when(F.col("class").isNotNull(), 1).otherwise(0)
    delay = F.least(F.lit(30.0), F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)), F.lit(6)) - 1))
    until = F.lit(now) + F.greatest(delay, F.coalesce("retry_after", F.lit(0.0)))
    kind = F.when(F.col("class").isNotNull() & ~F.col("class").isin(*RETRIED), "failed").otherwise(F.col("kind"))
    return both.select("path", kind.alias("kind"), "generation", attempt.cast("int").alias("attempt"), F.when(F.col("class").isin(*RETRIED), until).otherwise(F.col("not_before")).alias("not_before"))


def merge(base: DataFrame, changes: DataFrame, contents: DataFrame) -> DataFrame:
    """base (path, content, generation) after the newest changes: upserts take their content, removals go, stale changes don't count."""
    newest = latest(changes).withColumnRenamed("generation", "g")
    joined = base.join(newest, "path", "full_outer")
    wins = F.col("g").isNotNull() & (F.col("generation").isNull() | (F.col("g") > F.col("generation")))
    fresh = contents.select("path", F.col("generation").alias("cg"), F.col("content").alias("fresh"))
    kept = joined.where(~(wins & (F.col("kind") == "remove"))).withColumn("wins", wins)
    out = kept.join(fresh, (kept["path"] == fresh["path"]) & (kept["g"] == fresh["cg"]), "left").select(kept["path"], F.when(F.col("wins"), F.col("fresh")).otherwise(F.col("content")).alias("content"), F.when(F.col("wins"), F.col("g")).otherwise(F.col("generation")).alias("generation"))
    return out.where(F.col("generation").isNotNull())


def status(work: DataFrame, total: int) -> DataFrame:
    """indexed, total, pending and phase (warming, ready or degraded)."""
    counts = work.agg(F.count_if(F.col("kind") == "done").alias("indexed"), F.count_if(F.col("kind").isin("upsert", "remove", "awaiting_lexical")).alias("pending"), F.count_if(F.col("kind") == "failed").alias("failed"))
    phase = F.when(F.col("failed") > 0, "degraded").when(F.col("pending") > 0, "warming").otherwise("ready")
    return counts.select("indexed", F.lit(total).cast("long").alias("total"), "pending", phase.alias("phase"))


def initial_generations(paths: DataFrame) -> DataFrame:
    """Generations in path order for a first pass: ranges are numbered apart, so no single task sorts all paths."""
    sorted_rows = paths.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = sorted_rows.groupBy("part").agg(F.count("*").alias("size"))
    from pyspark.sql import Window

    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return sorted_rows.join(F.broadcast(offsets), "part").select("path", (F.col("before") + F.col("n") + 1).alias("generation"))


def refreshed(tracked: DataFrame, present: DataFrame) -> DataFrame:
    """tracked (path, revision, size, modified) with the present size and time where the revision is the same."""
    now = present.select("path", F.col("revision").alias("r"), F.col("size").alias("s"), F.col("modified").alias("m"))
    same = F.col("r") == F.col("revision")
    return tracked.join(now, "path", "left").select("path", "revision", F.when(same, F.col("s")).otherwise(F.col("size")).alias("size"), F.when(same, F.col("m")).otherwise(F.col("modified")).alias("modified"))


def warm_start(saved: DataFrame | None, paths: DataFrame, first_pass_complete: bool) -> tuple[DataFrame | None, bool]:
    """Saved vectors of notes that still exist and whether they can be queried at once; None makes a rebuild."""
    if saved is None:
        return None, False
    return saved.join(paths.select("path"), "path", "left_semi"), first_pass_complete
