"""Regular-expression and literal search with contexts, listings, budgeted reads and previews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATTERN_BYTES = 1000
#: Java's flags for the same reading of a pattern: Unicode classes, Unicode case where case is ignored, lines end at \n only.
_FLAGS = "(?dUu)"
_MATCH = pa.struct([("context", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int64())])
_MATCHES = "path string, matches array<struct<context:string,start:bigint,end:bigint,line:bigint>>"


def check_pattern(pattern: str) -> None:
    """Patterns must be short, valid and free of look-around and back-references, which not all engines have."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError("the pattern is too long")
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!])|\\[1-9])", pattern):
        raise ValueError("look-around and back-references aren't supported")
    try:
        regex.compile(pattern, regex.V0)
    except regex.error as e:
        raise ValueError(f"invalid pattern: {e}") from e


def word_pattern(query: str) -> str | None:
    """Any of the query's words, whatever their case."""
    words = query.split()
    return "(?i)(?:" + "|".join(map(re.escape, words)) + ")" if words else None


def contexts(content: str, pattern: regex.Pattern, around: int) -> list[dict]:
    """Each match with `around` bytes on either side (to whole characters), its place there and its line."""
    out, line, last = [], 0, 0
    for m in pattern.finditer(content):
        a, b = m.span()
        line, last = line + content.count("\n", last, a), a
        left = content[max(0, a - around) : a].encode()[-around:] if around else b""
        right = content[b : b + around].encode()[:around] if around else b""
        # a cut character is kept whole
        while left and left[0] & 0xC0 == 0x80:
            left = content[max(0, a - around) : a].encode()[-(len(left) + 1) :]
        n = len(right)
        tail = content[b : b + around].encode()
        while n < len(tail) and tail[n] & 0xC0 == 0x80:
            n += 1
        before = left.decode()
        out.append({"context": before + m[0] + tail[:n].decode(), "start": len(before), "end": len(before) + b - a, "line": line})
    return out


def with_contexts(notes: DataFrame, pattern: str, around: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]):
        compiled = regex.compile(pattern, regex.V0)
        for b in batches:
            got = [contexts(c or "", compiled, around) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(got, pa.list_(_MATCH))], names=["path", "matches"])

    return notes.select("path", "content").mapInArrow(of, _MATCHES)


def search_regex(notes: DataFrame, pattern: str, limit: int = 20, around: int = 100) -> DataFrame:
    """The first `limit` notes by path that match, with all their matches; contents are filtered before Python sees them."""
    check_pattern(pattern)
    hits = notes.where(F.col("content").rlike(_FLAGS + pattern)).orderBy("path").limit(max(0, limit))
    return with_contexts(hits, pattern, around).where(F.size("matches") > 0)


def search_literal(notes: DataFrame, query: str, limit: int = 20, around: int = 100) -> DataFrame:
    """Notes that hold the query, whatever its case; an empty query finds nothing."""
    if not query.strip():
        return with_contexts(notes.limit(0), "x", around)
    return search_regex(notes, "(?i)" + re.escape(query.strip()).replace("\\ ", " "), limit, around)


def preview(evidence: str, query: str, most: int = 300, before: int = 150) -> str:
    """At most `most` characters around the first query word in the evidence, else its start."""
    pattern = word_pattern(query)
    m = re.search(pattern, evidence) if pattern else None
    at = max(0, min(m.start() - before, len(evidence) - most)) if m else 0
    return evidence[at : at + most]


def directories(files: DataFrame) -> DataFrame:
    """Every folder on the way to a file."""
    parts = F.split("path", "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return files.select(F.explode(up).alias("path")).distinct()


def listing(files: DataFrame, folder: str = "", recursive: bool = False, glob: str | None = None, max_depth: int | None = None, with_directories: bool = True) -> DataFrame:
    """Files and folders below a folder, in order of their path components."""
    from marginalia.functions import paths

    folder = paths.normalize(folder)
    rows = files.select("path", F.lit("file").alias("kind"))
    if with_directories:
        rows = rows.unionByName(directories(files).withColumn("kind", F.lit("directory")))
    if folder:
        rows = rows.where(F.startswith("path", F.lit(folder + "/")))
    depth = F.size(F.split("path", "/")) - (folder.count("/") + 1 if folder else 0)
    most = max_depth if recursive else 1
    rows = rows.withColumn("depth", depth)
    if most is not None:
        rows = rows.where(F.col("depth") <= most)
    if glob:
        rows = rows.where(F.col("path").rlike(paths.glob_regex(glob)))
    return rows.orderBy(F.split("path", "/"))


def open_hints(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path, subpath, exists) of targets such as `folder/note.md#Heading`: what they name, and whether it is there."""
    parts = F.split("target", "#", 2)
    named = wanted.select("target", F.get(parts, 0).alias("path"), F.get(parts, 1).alias("subpath"))
    there = files.select(F.col("path").alias("_path")).distinct()
    return named.join(there, F.col("path") == F.col("_path"), "left").select("target", "path", "subpath", F.col("_path").isNotNull().alias("exists"))


def tree(paths_in_order: list[str]) -> str:
    """A listing in component order drawn as a tree."""
    nodes: dict = {}
    for p in paths_in_order:
        at = nodes
        for part in p.split("/"):
            at = at.setdefault(part, {})
    out = []

    def draw(node: dict, lead: str) -> None:
        for n, (name, below) in enumerate(sorted(node.items())):
            last = n == len(node) - 1
            out.append(f"{lead}{'└── ' if last else '├── '}{name}")
            draw(below, lead + ("    " if last else "│   "))

    draw(nodes, "")
    return "\n".join(out)


def within_budget(candidates: Column, max_bytes: int) -> Column:
    """For an ordered array of (path, size): each with whether it still fits; smaller later ones may fit after a skip."""
    start = F.struct(F.lit(max_bytes).cast("long").alias("left"), F.array().cast("array<struct<path:string,size:bigint,taken:boolean>>").alias("out"))
    return F.aggregate(
        candidates,
        start,
        lambda acc, c: F.struct(
            (acc["left"] - F.when(c["size"] <= acc["left"], c["size"]).otherwise(0)).alias("left"),
            F.concat(acc["out"], F.array(F.struct(c["path"].alias("path"), c["size"].alias("size"), (c["size"] <= acc["left"]).alias("taken")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def read_many(notes: DataFrame, max_files: int = 20, max_bytes: int = 65_536) -> DataFrame:
    """The first max_files (100 at most) notes by path: size, whether they fit into max_bytes, content if so, else why not."""
    first = notes.select("path", F.octet_length("content").cast("long").alias("size")).orderBy("path").limit(min(100, max(1, max_files)))
    ordered = first.agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("c"))
    planned = ordered.select(F.explode(within_budget(F.col("c"), max_bytes)).alias("x")).select("x.*")
    texts = notes.select(F.col("path").alias("_path"), "content").join(F.broadcast(planned.where("taken").select(F.col("path").alias("_path"))), "_path", "left_semi")
    found = planned.join(texts, F.col("path") == F.col("_path"), "left").drop("_path")
    return found.withColumn("skipped", F.when(~F.col("taken"), F.when(F.col("size") > max_bytes, "larger than the budget").otherwise("no room left"))).orderBy("path")


def read_counts(read: DataFrame) -> DataFrame:
    """found, returned, skipped and bytes of what read_many gives."""
    return read.agg(F.count("*").alias("found"), F.count_if("taken").alias("returned"), F.count_if(~F.col("taken")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0)).alias("bytes"))


def page(content: str, start: int = 0, end: int | None = None, max_bytes: int = 65_536) -> dict:
    """Bytes from start to end of a note, cut to whole characters; next is where the following page starts."""
    raw = content.encode()
    stop = min(len(raw) if end is None else end, len(raw))
    if not 0 <= start <= stop:
        raise ValueError("the range is outside the note")
    cut = min(stop, start + max_bytes)
    while cut > start and cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut -= 1
    return {"content": raw[start:cut].decode("utf-8", "ignore"), "start": start, "end": cut, "next": cut if cut < stop else None}
