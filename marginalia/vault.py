"""A vault: one corpus of notes behind the operations that tools call.

Reads are lazy DataFrames over the notes; what changes notes goes through a driver-side folder, one writer at
a time, and bumps the view so that the next read sees it.
"""

from __future__ import annotations

import os
import threading
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import frontmatter, markdown, paths, periodic
from marginalia.operators import access, graph, lexical, notes, postings, search, vectors
from marginalia.session import shared_dir
from marginalia.sources import folder

# Limits of results and contexts.
MAX_RESULTS, MAX_CONTEXT, MAX_TOP_K = 200, 2000, 100


class Vault:
    """Notes (path, content) with optional other files (path, class, size), a folder to write to and chunk vectors."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, others: DataFrame | None = None, root: str | None = None, chunks: DataFrame | None = None, rules: list[str] = ()):
        self.spark, self.root, self.rules, self.chunk_vectors = spark, root, list(rules), chunks
        self._corpus, self._others = corpus, others
        self._lock = threading.Lock()
        self._parsed: DataFrame | None = None
        self._index: postings.PostingIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, rules: list[str] = ()) -> Vault:
        """A folder of notes; `.vaultignore` lines there are exclusion rules too."""
        ignore = os.path.join(root, ".vaultignore")
        extra = paths.ignore_lines(open(ignore, encoding="utf-8").read()) if os.path.exists(ignore) else []
        merged = paths.exclusion_rules(list(rules), extra)
        vault = cls(spark, folder.notes(spark, root, merged), None, root, rules=merged)
        vault._others = folder.inventory(spark, root, merged)
        return vault

    # views

    @property
    def parsed(self) -> DataFrame:
        """Parsed notes; those with broken front matter are left out (see rejected)."""
        if self._parsed is None:
            # parsed once for all branches of a plan; what doesn't fit in memory goes to disk, what is lost is parsed again
            self._parsed = notes.parse(self._corpus).persist()
        return notes.indexed(self._parsed)

    def rejected(self) -> DataFrame:
        """Notes that no view holds: broken front matter, or larger than a note may be."""
        self.parsed  # noqa: B018  makes the view
        found = notes.rejected(self._parsed)
        return found if self._others is None or "size" not in self._others.columns else found.unionByName(folder.oversized(self._others))

    @property
    def index(self) -> postings.PostingIndex:
        """The lexical index over stems, built at the first search and kept up with every change made here."""
        if self._index is None:
            self._index = postings.PostingIndex.build(lexical.fields(self.parsed), f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}", stems=True)
        return self._index

    def files(self) -> DataFrame:
        found = self._corpus.select("path")
        return found if self._others is None else self._others.select("path").unionByName(found).distinct()

    def visible_to(self, policy: access.Policy) -> Vault:
        """The vault as a policy shows it: graph, tags and search statistics count what is readable only."""
        others = None if self._others is None else access.readable(self._others, policy)
        seen = Vault(self.spark, access.readable(self._corpus, policy), others, None, None if self.chunk_vectors is None else access.readable(self.chunk_vectors, policy))
        if self._index is not None:
            seen._index = self._index.view(access.decision(policy)["reason"] == "allowed")
        return seen

    # reading

    def list_files(self, directory: str = "", recursive: bool = False, glob: str | None = None, max_depth: int | None = None, metadata: bool = False) -> DataFrame:
        found = search.listing(self.files(), directory, recursive, glob, max_depth)
        if metadata:
            found = found.join(self.parsed.select("path", "title", "tags"), "path", "left").orderBy(F.split("path", "/"))
        return found

    def tree(self, directory: str = "", max_depth: int | None = None) -> str:
        return search.tree([r["path"] for r in self.list_files(directory, True, None, max_depth).select("path").collect()])

    def stats(self) -> DataFrame:
        rest = None if self._others is None else self._others.where(F.col("class") != "note").select("class", "size")
        return notes.stats(self.parsed, rest)

    def read(self, path: str, rng: tuple[int, int] | None = None, expected_revision: str | None = None, max_bytes: int | None = None) -> dict:
        """A note's text, or a page of it, with its revision; a revision that differs from the expected one is an error."""
        path = paths.normalize(path)
        row = self._corpus.where(F.col("path") == path).select("content", notes.source_revision(F.col("content")).alias("revision")).first()
        if row is None:
            raise FileNotFoundError(path)
        if expected_revision is not None and expected_revision != row["revision"]:
            raise ValueError(f"{path} has changed")
        start, end = rng or (0, None)
        size = len(row["content"].encode())
        return search.page(row["content"], start, end, size + 1 if max_bytes is None else max_bytes) | {"revision": row["revision"]}

    def read_many(self, paths_or_dir: list[str] | str, recursive: bool = False, glob: str | None = None, max_files: int = 20, max_bytes: int = 65_536) -> DataFrame:
        if isinstance(paths_or_dir, str):
            wanted = search.listing(self._corpus.select("path"), paths_or_dir, recursive, glob, with_directories=False).select("path")
            own = self._corpus.join(wanted, "path", "left_semi")
        else:
            own = self._corpus.where(F.col("path").isin([paths.normalize(p) for p in paths_or_dir]))
        return search.read_many(own, max_files, max_bytes)

    def inspect(self, path: str) -> DataFrame:
        found = graph.resolved(self.parsed)
        return graph.backlink_counts(self.parsed, found).where(F.col("path") == paths.normalize(path))

    def targets(self, path: str) -> dict:
        return markdown.document_map(self.read(path)["content"])

    def headings(self, path: str, offset: int = 0, limit: int = 100, max_bytes: int = 65_536) -> DataFrame:
        own = self.parsed.where(F.col("path") == paths.normalize(path))
        return notes.heading_page(notes.heading_tree(own), own, offset, limit, max_bytes)

    def frontmatter(self, path: str) -> dict | None:
        return frontmatter.parse(self.read(path)["content"])

    # searching

    def search_text(self, query: str, context: int = 100, limit: int = 20, fuzzy: bool = False, fields: list[str] | None = None) -> DataFrame:
        """Ranked notes with the contexts of the query's words; fuzzy and field-restricted search rank as they say."""
        limit, context = min(max(0, limit), MAX_RESULTS), min(max(0, context), MAX_CONTEXT)
        names = {"title": "title", "headings": "headings", "tags": "facets", "body": "body", "frontmatter": "frontmatter"}
        for f in fields or ():
            if f.lower() not in names:
                raise ValueError(f"unknown field {f!r}")
        terms = self.index.terms(query)
        if not fuzzy and fields is None:
            hits = self.index.search(query, limit)
        else:
            some = {f: lexical.BOOSTS[f] for f in (map(str.lower, fields) if fields else lexical.BOOSTS) if f in lexical.BOOSTS}
            found = (self.index.fuzzy_scores if fuzzy else self.index.scores)(terms, some) if some and terms else None
            if fields and "tags" in map(str.lower, fields):
                tags = self.index.facet_scores(query.lower().split())
                found = tags if found is None else found.unionByName(tags).groupBy("path").agg(F.sum("score").alias("score"))
            hits = lexical.top(found, limit) if found is not None else self._corpus.select("path", F.lit(0.0).alias("score")).limit(0)
        return self._with_contexts(hits, search.word_pattern(query), context)

    def _with_contexts(self, hits: DataFrame, pattern: str | None, context: int) -> DataFrame:
        own = self._corpus.join(F.broadcast(hits.select("path")), "path", "left_semi")
        return hits.join(search.with_contexts(own, pattern or r"(?!)", context), "path", "left").orderBy(F.desc("score"), "path")

    def search_regex(self, pattern: str, context: int = 100, limit: int = 20) -> DataFrame:
        return search.search_regex(self._corpus, pattern, min(max(0, limit), MAX_RESULTS), min(max(0, context), MAX_CONTEXT))

    def by_tag(self, tag: str, nested: bool = True) -> DataFrame:
        return self.parsed.where(notes.under_tag(tag) if nested else notes.has_tag(tag)).select("path", "title", "tags")

    def by_property(self, key: str, operator: str = "eq", value=None) -> DataFrame:
        tests = {"eq": notes.property_equals, "contains": notes.property_contains, "exists": lambda k, _: notes.property_exists(k)}
        if operator.lower() not in tests:
            raise ValueError(f"unknown operator {operator!r}")
        return self.parsed.where(tests[operator.lower()](key, value)).select("path", "title", "frontmatter")

    def search_semantic(self, vector: list[float], k: int = 10, query: str | None = None, alpha: float = 0.25) -> DataFrame:
        """Best notes by their best chunk; with a query, lexical hits re-ranked by both scores."""
        k = min(max(1, k), MAX_TOP_K)
        live = vectors.live_only(self.chunk_vectors, self._corpus)
        if query is None:
            return vectors.semantic(live, vector, k)
        hits = lexical.top(self.index.scores(self.index.terms(query)), max(50, k), live.select("path"))
        return vectors.hybrid(lexical.normalized(hits), vectors.best_chunks(live, vector), k, alpha)

    def search_semantic_text(self, query: str, embed, k: int = 10, alpha: float | None = 0.25, most: int = 300) -> DataFrame:
        """Semantic search for a text: `embed` gives its vector; hits carry their best chunk's place, state and preview.

        With alpha None only the vectors count. A preview is taken from the note as it is now, if the chunk's place is still there.
        """
        if not query.strip():
            raise ValueError("an empty query")
        found = self.search_semantic(list(embed(query)), k, None if alpha is None else query, alpha or 0.0)
        own = self._corpus.join(F.broadcast(found.select("path")), "path", "left_semi").select("path", "content")
        both = found.join(own, "path", "left")

        @F.udf("struct<status:string,preview:string>", useArrow=True)
        def shown(content, start, end):
            if content is None:
                return ("unavailable", None)
            raw = content.encode()
            if start is None or start > len(raw):
                return ("changed", None)
            return ("current", search.preview(raw[start : len(raw) if end is None else end].decode("utf-8", "ignore"), query, most))

        start, end = (F.col(c) if c in both.columns else F.lit(None).cast("long") for c in ("start", "end"))
        return both.withColumn("evidence", shown("content", start, end)).select(*found.columns, "evidence.status", "evidence.preview").orderBy(F.desc("score"), "path")

    # links

    def backlinks(self, path: str) -> DataFrame:
        return graph.backlinks(graph.resolved(self.parsed), paths.normalize(path))

    def outgoing(self, path: str) -> DataFrame:
        return graph.outgoing(graph.resolved(self.parsed), paths.normalize(path))

    def broken_links(self, path: str | None = None) -> DataFrame:
        found = graph.broken(graph.resolved(self.parsed))
        return found if path is None else found.where(F.col("source") == paths.normalize(path))

    def orphans(self) -> DataFrame:
        return graph.orphans(self.parsed, graph.resolved(self.parsed)).orderBy("path")

    # writing

    def _at(self, path: str) -> str:
        if self.root is None:
            raise PermissionError("this view of the vault is read-only")
        rel = paths.normalize(path)
        if not paths.is_visible(rel):
            raise ValueError(f"not a visible path: {path!r}")
        return os.path.join(self.root, rel)

    def _put(self, path: str, content: str) -> None:
        full = self._at(path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        part = f"{full}.{os.getpid()}.part"
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.replace(part, full)
        self._refresh(paths.normalize(path))

    def _refresh(self, *changed: str) -> None:
        """Read the folder again; the index takes the notes at the changed paths as they are now."""
        if self._index is not None:
            now = {p: c for p in changed if paths.is_markdown(p) and (c := self._text(p)) is not None}
            corpus = self.spark.createDataFrame(list(now.items()), "path string, content string")
            gone = self.spark.createDataFrame([(p,) for p in changed], "path string")
            parsed = notes.indexed(notes.parse(corpus.where(~folder.excluded(F.col("path"), self.rules))))
            self._index.replace(lexical.fields(parsed), gone)
        if self._parsed is not None:
            self._parsed.unpersist()
        self._corpus, self._others, self._parsed = folder.notes(self.spark, self.root, self.rules), folder.inventory(self.spark, self.root, self.rules), None

    def _text(self, path: str) -> str | None:
        full = self._at(path)
        if not os.path.exists(full):
            return None
        with open(full, encoding="utf-8", newline="") as f:
            return f.read()

    def create(self, path: str, content: str = "", properties: dict | None = None) -> None:
        with self._lock:
            if os.path.exists(self._at(path)):
                raise FileExistsError(path)
            self._put(path, frontmatter.with_frontmatter(content, properties) if properties is not None else content)

    def write(self, path: str, content: str, expected_revision: str | None = None) -> None:
        """Overwrite a note; with an expected revision only if the note still has it."""
        with self._lock:
            if expected_revision is not None:
                from hashlib import sha256

                now = self._text(path)
                if now is None or sha256(now.encode()).hexdigest() != expected_revision:
                    raise ValueError(f"{path} has changed")
            self._put(path, content)

    def insert(self, path: str, content: str, position: str = "end") -> None:
        if position.lower() not in ("end", "beginning"):
            raise ValueError(f"unknown position {position!r}")
        with self._lock:
            now = self._text(path) or ""
            self._put(path, frontmatter.append(now, content) if position.lower() == "end" else frontmatter.prepend(now, content))

    def patch(self, path: str, operation: str, target_type: str, target: str, content: str) -> None:
        with self._lock:
            now = self._text(path)
            if now is None:
                raise FileNotFoundError(path)
            self._put(path, markdown.patch(now, operation.lower(), target_type.lower(), target, content))

    def set_property(self, path: str, key: str, value) -> None:
        with self._lock:
            self._put(path, frontmatter.set_field(self._text(path) or "", key, value))

    def remove_property(self, path: str, key: str) -> None:
        with self._lock:
            self._put(path, frontmatter.remove_field(self._text(path) or "", key))

    def move(self, old: str, new: str) -> None:
        """Rename a note; nothing is overwritten and links stay as they are."""
        with self._lock:
            if os.path.exists(self._at(new)):
                raise FileExistsError(new)
            os.makedirs(os.path.dirname(self._at(new)), exist_ok=True)
            os.rename(self._at(old), self._at(new))
            self._refresh(paths.normalize(old), paths.normalize(new))

    def delete(self, path: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("deleting needs confirm=True")
        with self._lock:
            os.remove(self._at(path))
            self._refresh(paths.normalize(path))

    # periodic notes

    def _config(self, period: str) -> dict:
        def at(*names):
            full = os.path.join(self.root, *names) if self.root else ""
            return open(full, encoding="utf-8").read() if full and os.path.exists(full) else None

        return periodic.config(period.lower(), at(".obsidian", "plugins", "periodic-notes", "data.json"), at(".obsidian", "daily-notes.json"))

    def periodic_path(self, period: str, day: date | None = None) -> str:
        c = self._config(period)
        return periodic.note_path(day or date.today(), c["format"], c["folder"])

    def periodic_get(self, period: str, day: date | None = None) -> dict:
        return self.read(self.periodic_path(period, day))

    def periodic_create(self, period: str, day: date | None = None, content: str | None = None) -> str:
        day, c = day or date.today(), self._config(period)
        path = self.periodic_path(period, day)
        if content is None:
            template = c["template"] and (c["template"] if c["template"].endswith(".md") else c["template"] + ".md")
            content = periodic.expand_template(self._text(template) or "", day, paths.stem(path)) if template else ""
        self.create(path, content)
        return path

    def periodic_list(self, period: str, limit: int = 10) -> list[tuple[date, str]]:
        """The newest notes of a period, newest first."""
        c = self._config(period)
        own = self._corpus.select("path")
        if c["folder"]:
            own = own.where(F.startswith("path", F.lit(c["folder"].strip("/") + "/")))
        fmt, cut = c["format"], len(c["folder"].strip("/")) + 1 if c["folder"] else 0
        parse = F.udf(lambda p: periodic.parse_date(p[cut:].removesuffix(".md"), fmt), "date", useArrow=True)
        found = own.withColumn("day", parse("path")).where("day IS NOT NULL").orderBy(F.desc("day"), "path").limit(limit)
        return [(r["day"], r["path"]) for r in found.collect()]
