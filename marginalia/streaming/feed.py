"""The change feed as a stream: each micro-batch is coalesced by path and merged, lexical before vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators import notes, postings
from marginalia.operators.lexical import fields as lexical_fields

CHANGE = "path string, kind string, generation bigint"
_STATE = "generation bigint"


def changes(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of changes from a folder of JSON files; how many files a batch takes is its debounce."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def newest_only(stream: DataFrame) -> DataFrame:
    """Changes whose generation is above all earlier ones of their path, across batches; stale ones are dropped."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        best = None
        for f in frames:
            top = f.sort_values(["generation", "kind"]).iloc[-1:]
            if best is None or top["generation"].iloc[0] > best["generation"].iloc[0]:
                best = top
        if best is not None and (seen is None or best["generation"].iloc[0] > seen):
            state.update((int(best["generation"].iloc[0]),))
            yield best[["path", "kind", "generation"]]

    return stream.groupBy("path").applyInPandasWithState(keep, CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)


def index_sink(index: postings.PostingIndex, contents: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A lexical sink: the notes of a batch (contents gives path and content of its paths) go into the index as one segment.

    A batch that is run again after a failure writes the same notes once more, which changes nothing.
    """

    def apply(batch: DataFrame, n: int) -> None:
        upserts = contents(batch.where("kind = 'upsert'").select("path"))
        index.replace(lexical_fields(notes.indexed(notes.parse(upserts))), batch.where("kind = 'remove'").select("path"))

    return apply


def run(stream: DataFrame, checkpoint: str, lexical: Callable[[DataFrame, int], None], vectors: Callable[[DataFrame, int], None] | None = None, every: str | None = None):
    """Start the feed: every batch's newest changes go to the lexical sink, then to the vector sink.

    `every` (such as "500 milliseconds") keeps it running and gathers the changes of that time into a batch;
    without it what is there is worked off and the feed ends.
    """

    def both(batch: DataFrame, n: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("kind", "generation").alias("kind"), F.max("generation").alias("generation")).persist()
        try:
            lexical(newest, n)
            if vectors is not None:
                vectors(newest, n)
        finally:
            newest.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
