"""A lexical index that is written once: postings by term, kept in segments that replace and remove notes by path.

A segment has three tables: postings (term, field, path, count, field length, positions) partitioned by the
term's hash and sorted by term, its notes (path, whether it only removes, field lengths), and the sums of field
lengths. A query reads the partitions and row groups of its terms, whatever the corpus holds; notes of a later
segment hide those of earlier ones, so statistics are always those of the notes that are there. compact() merges
all segments into one. Ranking is lexical.scores over the same numbers.

Defined cases: a note without tokens has no postings but counts as a note; the same path twice within one
segment is two notes; an empty corpus gives no hits; a segment is there once its last table is written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.stemmer import stem
from marginalia.operators import lexical
from marginalia.session import names_in, remove_tree

BUCKETS, SALTS = 64, 8
#: Notes of later segments up to which their paths are broadcast; more are joined by a shuffle.
BROADCAST_PATHS = 200_000
#: Tokens that are counted at once, unless one note has more.
PART_TOKENS = 200_000
FIELDS = (*lexical.BOOSTS, "facets")
_POSTINGS = "term string, field string, path string, tf int, dl int, positions array<int>"


def _inverted(stems: bool):
    def of(batches: Iterator[pa.RecordBatch]):
        known: dict[str, str | None] = {}

        def cut(word: str) -> str | None:
            if word not in known:
                if len(known) > 1 << 18:
                    known.clear()
                known[word] = stem(word) if len(word.encode()) < lexical.MAX_TOKEN_BYTES else None
            return known[word]

        for batch in batches:
            for part in _parts(batch):
                for field in FIELDS:
                    rows = _counted(part, field, cut if stems and field != "facets" else None)
                    if rows.num_rows:
                        yield rows

    return of


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold PART_TOKENS tokens or one note."""
    sizes = sum(pc.fill_null(pc.list_value_length(batch.column(f)), 0).to_numpy().astype(np.int64) for f in FIELDS)
    first = tokens = 0
    for n, size in enumerate(sizes.tolist()):
        if n > first and tokens + size > PART_TOKENS:
            yield batch.slice(first, n - first)
            first, tokens = n, 0
        tokens += size
    yield batch.slice(first)


def _counted(part: pa.RecordBatch, field: str, cut: Callable[[str], str | None] | None) -> pa.RecordBatch:
    """Postings of one field: a row for each note and term, with the term's places among the note's tokens that `cut` leaves."""
    lists = part.column(field)
    found = lists.flatten().dictionary_encode()
    note = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    terms, term = found.dictionary.to_pylist(), found.indices.to_numpy()
    if cut is not None:
        numbers: dict[str, int] = {}
        of_word = np.array([-1 if (w := cut(t)) is None else numbers.setdefault(w, len(numbers)) for t in terms], np.int64)
        terms, term = list(numbers), of_word[term] if len(terms) else term
        note, term = note[term >= 0], term[term >= 0]
    lengths = np.bincount(note, minlength=part.num_rows)
    place = np.arange(len(note)) - (np.cumsum(lengths) - lengths)[note]
    key = note * max(1, len(terms)) + term
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    of_row = order[starts]
    ends = np.append(starts, len(order)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(terms, pa.string()).take(pa.array(term[of_row])), pa.array([field] * len(starts), pa.string()), part.column("path").take(pa.array(note[of_row])),
            pa.array(np.diff(ends), pa.int32()), pa.array(lengths[note[of_row]], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order], pa.int32())),
        ],
        names=["term", "field", "path", "tf", "dl", "positions"],
    )


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _buckets(terms: list[str]) -> set[int]:
    return {zlib.crc32(t.encode()) % BUCKETS for t in terms}


class PostingIndex:
    """The segments under `path`, as far as `visible` (a predicate on path) shows them."""

    def __init__(self, spark: SparkSession, path: str, stems: bool, visible: Column | None = None):
        self.spark, self.path, self.stems, self.visible = spark, path.rstrip("/"), stems, visible
        self.segments = [n for n in names_in(spark, self.path) if n.startswith("segment-") and "_SUCCESS" in names_in(spark, f"{self.path}/{n}/sums")]

    @classmethod
    def build(cls, corpus: DataFrame, path: str, stems: bool = False) -> PostingIndex:
        """An index over rows of lexical.fields (path, the token fields, facets)."""
        index = cls(corpus.sparkSession, path, stems)
        index.replace(corpus)
        return index

    def view(self, visible: Column) -> PostingIndex:
        """The same index as if only the notes with a visible path were there; nothing is written through a view."""
        return PostingIndex(self.spark, self.path, self.stems, visible)

    # writing

    def replace(self, corpus: DataFrame, removed: DataFrame | None = None) -> None:
        """Add notes, or replace those with the same paths; `removed` (path) are taken out."""
        if self.visible is not None:
            raise PermissionError("a view is read-only")
        last = int(self.segments[-1].split("-")[1]) if self.segments else 0
        name = f"segment-{last + 1:08d}-{uuid.uuid4().hex[:8]}"
        top = f"{self.path}/{name}"
        rows = corpus.select("path", *FIELDS).mapInArrow(_inverted(self.stems), _POSTINGS)
        dealt = rows.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
        dealt.sortWithinPartitions("bucket", "term", "field", "path").write.partitionBy("bucket").parquet(f"{top}/postings")
        # lengths are those of the postings' tokens: of stems where long tokens go
        long = F.lit(lexical.MAX_TOKEN_BYTES)
        length = lambda f: F.size(F.filter(f, lambda w: F.octet_length(w) < long) if self.stems else f).cast("long")
        notes = corpus.select("path", F.lit(False).alias("gone"), *[length(f).alias(f) for f in lexical.BOOSTS])
        if removed is not None:
            notes = notes.unionByName(removed.select("path", F.lit(True).alias("gone")), allowMissingColumns=True)
        notes.write.parquet(f"{top}/notes")
        written = self.spark.read.parquet(f"{top}/notes").where(~F.col("gone"))
        written.agg(F.count("*").alias("notes"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in lexical.BOOSTS]).coalesce(1).write.parquet(f"{top}/sums")
        self.segments.append(name)

    def remove(self, paths: DataFrame) -> None:
        """Take notes (path) out."""
        empty = self.spark.createDataFrame([], "path string, " + ", ".join(f"{f} array<string>" for f in FIELDS))
        self.replace(empty, paths)

    def compact(self) -> None:
        """All segments as one; the old ones go once the new one is there."""
        old, top = list(self.segments), f"{self.path}/segment-{int(self.segments[-1].split('-')[1]) + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows = self._live("postings").withColumn("bucket", _bucket(F.col("term")))
        rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "field", "path").write.partitionBy("bucket").parquet(f"{top}/postings")
        self._live("notes").where(~F.col("gone")).write.parquet(f"{top}/notes")
        self.spark.read.parquet(f"{top}/notes").agg(F.count("*").alias("notes"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in lexical.BOOSTS]).coalesce(1).write.parquet(f"{top}/sums")
        self.segments = [top.rsplit("/", 1)[1]]
        for name in old:
            remove_tree(self.spark, f"{self.path}/{name}")

    # reading

    def _table(self, segment: str, name: str, buckets: set[int] | None = None) -> DataFrame:
        if name == "postings":
            top, schema = f"{self.path}/{segment}/postings", _POSTINGS + ", bucket int"
            if buckets is None:
                return self.spark.read.schema(schema).parquet(top)
            # only the wanted folders are listed
            there = set(names_in(self.spark, top))
            wanted = [f"{top}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
            return self.spark.read.schema(schema).option("basePath", top).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)
        return self.spark.read.schema("path string, gone boolean, " + ", ".join(f"{f} bigint" for f in lexical.BOOSTS)).parquet(f"{self.path}/{segment}/notes")

    def _live(self, name: str, keep: Column | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a table, without those of notes that a later segment has."""
        out = None
        for n, segment in enumerate(self.segments):
            rows = self._table(segment, name, buckets)
            rows = rows if keep is None else rows.where(keep)
            rows = rows if self.visible is None else rows.where(self.visible)
            later = None
            for other in self.segments[n + 1 :]:
                own = self._table(other, "notes").select("path")
                later = own if later is None else later.unionByName(own)
            if later is not None:
                few = later.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
                rows = rows.join(F.broadcast(later) if few else later, "path", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out.drop("bucket")

    def _sums(self) -> DataFrame:
        """One row: number of notes and sum of lengths of each field."""
        if len(self.segments) == 1 and self.visible is None:
            return self.spark.read.parquet(f"{self.path}/{self.segments[0]}/sums")
        return self._live("notes").where(~F.col("gone")).agg(F.count("*").alias("notes"), *[F.sum(f).alias(f) for f in lexical.BOOSTS])

    def postings(self, terms: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """The live postings of some terms; only their partitions are read."""
        return self._live("postings", F.col("term").isin(terms) & F.col("field").isin(*fields), _buckets(terms))

    def terms(self, query: str) -> list[str]:
        return lexical.query_terms(query, self.stems)

    def scores(self, terms: list[str], boosts: dict[str, float] = lexical.BOOSTS) -> DataFrame:
        """(path, score) of the notes that have any of the terms in any of the fields; the numbers are lexical.scores'."""
        if not terms or not boosts or not self.segments:
            return self.spark.createDataFrame([], "path string, score double")
        found = self.postings(terms, tuple(boosts)).select("path", "term", "field", "tf", "dl")
        df = found.groupBy("term", "field").agg(F.count("*").alias("df"))
        boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
        mean = F.element_at(F.create_map(*[x for f in boosts for x in (F.lit(f), F.col(f"sum_{f}") / F.col("docs"))]), F.col("field"))
        sums = self._sums().select(F.col("notes").alias("docs"), *[F.col(f).alias(f"sum_{f}") for f in boosts])
        rows = found.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(sums))
        t = F.col("tf").cast("double")
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = t + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / mean)
        parts = rows.select("path", (boost * idf * t * (lexical.K1 + 1) / norm).alias("part")).groupBy("path").agg(F.collect_list("part").alias("parts"))
        return parts.select("path", lexical.summed(F.col("parts")).alias("score"))

    def facet_scores(self, terms: list[str]) -> DataFrame:
        """Notes with a tag that is one of the terms or lies below it, FACET_BOOST for each."""
        rows = self._live("postings", F.col("field") == "facets")
        under = F.array(*[F.when((F.col("term") == t) | F.startswith("term", F.lit(t + "/")), F.lit(t)) for t in terms])
        return rows.select("path", F.explode(F.array_compact(under)).alias("t")).distinct().groupBy("path").agg((F.count("*") * lexical.FACET_BOOST).alias("score"))

    def fuzzy_scores(self, terms: list[str], boosts: dict[str, float] = lexical.BOOSTS) -> DataFrame:
        """Each field that has a token within one edit of a term counts its boost, once for each term."""
        rows = self._live("postings", F.col("field").isin(*boosts))
        near = F.array(*[F.when(lexical.fuzzy(F.col("term"), t), F.lit(t)) for t in terms])
        boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
        return rows.select("path", "field", F.explode(F.array_compact(near)).alias("t")).distinct().groupBy("path").agg(F.sum(boost).alias("score"))

    def search(self, query: str, k: int = 20, allowed: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        """The k best notes for a query in the query grammar; phrases are met by positions."""
        tree = lexical.parse_query(query)
        tree = lexical.with_stems(tree) if self.stems else tree
        wanted = lexical.tree_terms(tree)
        if k <= 0 or not wanted or not self.segments:
            return self.spark.createDataFrame([], "path string, score double")
        scores = self.scores(wanted)
        if not lexical.is_any(tree):
            held = self.postings(lexical.all_terms(tree)).groupBy("path").agg(F.collect_list(F.struct("field", "term", "positions")).alias("held"))
            scores = scores.join(held.where(_matching(tree)).select("path"), "path", "left_semi")
        return lexical.top(scores, k, allowed, digits)


def _matching(tree: dict) -> Column:
    """A query tree as a predicate over held, a note's postings of the query's terms."""
    if "terms" in tree:
        names = [("facets" if tree["field"] == "tags" else tree["field"])] if tree["field"] else list(lexical.BOOSTS)
        if not tree["phrase"] or len(tree["terms"]) < 2:
            return F.exists("held", lambda x: x["field"].isin(*names) & x["term"].isin(*tree["terms"]))
        found = F.lit(False)
        for name in names:
            at = lambda t: F.flatten(F.transform(F.filter("held", lambda x: (x["field"] == name) & (x["term"] == t)), lambda x: x["positions"]))  # noqa: B023, E731
            starts = at(tree["terms"][0])
            for n, t in enumerate(tree["terms"][1:], 1):
                starts = F.array_intersect(starts, F.transform(at(t), lambda p: p - n))  # noqa: B023
            found |= F.size(starts) > 0
        return found
    ok = F.lit(True)
    for x in tree["must"]:
        ok &= _matching(x)
    for x in tree["must_not"]:
        ok &= ~_matching(x)
    if tree["should"] and not tree["must"]:
        some = F.lit(False)
        for x in tree["should"]:
            some |= _matching(x)
        ok &= some
    return ok
