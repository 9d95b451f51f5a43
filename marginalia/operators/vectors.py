"""Exhaustive cosine search over chunk vectors, and ranking with lexical scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import names_in, remove_tree, rename

DIM_LIMIT = 65_536


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double precision between -1 and 1; zero for a vector without length."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    if not norm:
        return F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(own > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (own * norm)))).otherwise(0.0)


def best_chunks(chunks: DataFrame, query: list[float]) -> DataFrame:
    """(path, score, start) of each note's best chunk; of equal ones that which starts first."""
    scored = chunks.select("path", "start", cosine(F.col("vector"), query).alias("score"))
    best = scored.groupBy("path").agg(F.max_by(F.struct("score", "start"), F.struct("score", -F.col("start"))).alias("b"))
    return best.select("path", "b.score", "b.start")


def live_only(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path"), "path", "left_semi")


def semantic(chunks: DataFrame, query: list[float], k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    own = chunks if allowed is None else live_only(chunks, allowed)
    return best_chunks(own, query).orderBy(F.desc("score"), "path").limit(k)


def hybrid(lexical_hits: DataFrame, best: DataFrame, k: int = 10, alpha: float = 0.25) -> DataFrame:
    """alpha * normalised lexical + (1 - alpha) * cosine over the lexical hits; a hit without a vector is an error."""
    a = min(1.0, max(0.0, alpha))
    joined = lexical_hits.withColumnRenamed("score", "lexical").join(best, "path", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("path"))).cast("double")
    joined = joined.withColumn("score", F.when(F.col("score").isNull(), missing).otherwise(F.col("score")))
    return joined.select("path", "lexical", F.col("score").alias("cosine"), (a * F.col("lexical") + (1 - a) * F.col("score")).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def checked(hits: DataFrame, k: int, allowed: DataFrame) -> DataFrame:
    """hits (path, ...) as they are; more than k, a path twice or one that isn't allowed is an error when they are read."""
    from pyspark.sql import Window

    many, same = F.count("*").over(Window.partitionBy()), F.count("*").over(Window.partitionBy("path"))
    known = allowed.select(F.col("path").alias("_path")).distinct()
    found = hits.withColumns({"_many": many, "_same": same}).join(known, F.col("path") == F.col("_path"), "left")
    fault = F.when(F.col("_many") > k, F.raise_error(F.lit("more hits than asked for"))).when(F.col("_same") > 1, F.raise_error(F.lit("a note twice"))).when(F.col("_path").isNull(), F.raise_error(F.concat(F.lit("not allowed: "), F.col("path"))))
    return found.where(fault.cast("string").isNull()).select(*hits.columns)


def reuse(new_chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """new_chunks with the cached vector of the same input hash, or null where one has to be made."""
    known = cached.groupBy("input_hash").agg(F.first("vector", ignorenulls=True).alias("vector"))
    return new_chunks.join(known, "input_hash", "left")


def evidence_status(hits: DataFrame, current: DataFrame) -> DataFrame:
    """current, changed or unavailable for each hit (path, revision) against the notes as they are (path, revision)."""
    now = current.select("path", F.col("revision").alias("now"))
    return hits.join(now, "path", "left").select("path", F.when(F.col("now").isNull(), "unavailable").when(F.col("now") == F.col("revision"), "current").otherwise("changed").alias("status"))


#: The layout of a saved cache; other versions are rebuilt.
CACHE_VERSION = 2


def save(entries: DataFrame, path: str, identity: str, dim: int | None = None, first_pass_complete: bool = True) -> None:
    """Entries sorted by path under a folder named for the vector space they belong to, with a header.

    A save writes a generation of its own and gives it its name last, so readers see the one before or this one,
    and the entries may come from the cache that is saved. The generation before stays for who still reads it.
    """
    spark, top = entries.sparkSession, f"{path}/{identity}"
    olds = _generations(spark, top)
    new = f"{top}/writing-{uuid.uuid4().hex}"
    entries.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{new}/entries")
    made = spark.read.parquet(f"{new}/entries")
    header = made.agg(F.count("*").alias("entries"), F.max(F.size("vector")).alias("most"), F.min(F.size("vector")).alias("least")).first()
    dim = dim if dim is not None else header["most"] or 0
    if header["entries"] and (header["most"], header["least"]) != (dim, dim):
        remove_tree(spark, new)
        raise ValueError("vectors of different dimensions")
    spark.createDataFrame([(CACHE_VERSION, identity, int(dim), header["entries"], first_pass_complete)], _HEADER).coalesce(1).write.parquet(f"{new}/header")
    number = int(olds[-1].split("-")[1]) + 1 if olds else 1
    rename(spark, new, f"{top}/generation-{number:010d}")
    for name in olds[:-1]:
        remove_tree(spark, f"{top}/{name}")


_HEADER = "version int, identity string, dim int, entries bigint, first_pass_complete boolean"


def _generations(spark, top: str) -> list[str]:
    return [n for n in names_in(spark, top) if n.startswith("generation-")]


def load(spark, path: str, identity: str, dim: int | None = None) -> DataFrame | None:
    """The entries saved for a vector space; None where there are none, or their header is of another layout, space or dimension."""
    names = _generations(spark, f"{path}/{identity}")
    if not names:
        return None
    head = header(spark, path, identity)
    if head["version"] != CACHE_VERSION or head["identity"] != identity or dim is not None and head["dim"] != dim:
        return None
    return spark.read.parquet(f"{path}/{identity}/{names[-1]}/entries")


def header(spark, path: str, identity: str):
    """The header row of the saved cache (version, identity, dim, entries, first_pass_complete), or None."""
    names = _generations(spark, f"{path}/{identity}")
    return spark.read.schema(_HEADER).parquet(f"{path}/{identity}/{names[-1]}/header").first() if names else None


def embed(chunks: DataFrame, embedder, max_items: int = 32, max_tokens: int = 8192) -> DataFrame:
    """chunks (path, start, text, input_hash) with a vector each; requests are bounded, a task holds one Arrow batch."""
    import pyarrow as pa

    from marginalia.functions.embedders import in_batches

    def of(batches):
        for b in batches:
            vectors = in_batches(embedder, [t or "" for t in b.column("text").to_pylist()], max_items, max_tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    return chunks.select("path", "start", "text", "input_hash").mapInArrow(of, "path string, start bigint, text string, input_hash string, vector array<float>")


def embed_missing(chunks: DataFrame, cached: DataFrame, embedder) -> DataFrame:
    """(path, start, input_hash, vector): vectors of known inputs are taken over, each new input is embedded once."""
    found = reuse(chunks, cached)
    missing = found.where(F.col("vector").isNull()).groupBy("input_hash").agg(F.min("path").alias("path"), F.min("start").alias("start"), F.first("text").alias("text"))
    made = embed(missing, embedder).select("input_hash", F.col("vector").alias("made"))
    return found.join(made, "input_hash", "left").select("path", "start", "input_hash", F.coalesce("vector", "made").alias("vector"))
