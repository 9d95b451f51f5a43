"""Notes parsed into typed rows, and relations that follow from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import frontmatter, markdown, paths

#: Notes that are parsed at once.
PART_NOTES = 256

_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string()), ("line", pa.int64()), ("offset", pa.int64()), ("end", pa.int64())])
_LINK = pa.struct([("raw", pa.string()), ("target", pa.string()), ("heading", pa.string()), ("block_ref", pa.string()), ("alias", pa.string()), ("line", pa.int64()), ("key", pa.string())])
_BLOCK = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ROW = pa.schema([
    ("path", pa.string()), ("content", pa.string()), ("title", pa.string()), ("path_key", pa.string()), ("stem_key", pa.string()), ("tags", pa.list_(pa.string())), ("inline_tags", pa.list_(pa.string())), ("key_tags", pa.list_(pa.string())),
    ("frontmatter", pa.string()), ("property_text", pa.string()), ("properties", pa.map_(pa.string(), pa.string())), ("items", pa.map_(pa.string(), pa.list_(pa.string()))), ("headings", pa.list_(_HEADING)), ("blocks", pa.list_(_BLOCK)), ("links", pa.list_(_LINK)),
    ("block_refs", pa.list_(pa.string())), ("body_start", pa.int64()), ("error", pa.string()),
])
SCHEMA = (
    "path string, content string, title string, path_key string, stem_key string, tags array<string>, inline_tags array<string>, key_tags array<string>, frontmatter string, property_text string, properties map<string,string>, items map<string,array<string>>, "
    "headings array<struct<level:int,text:string,line:bigint,offset:bigint,end:bigint>>, blocks array<struct<kind:string,start:bigint,end:bigint>>, "
    "links array<struct<raw:string,target:string,heading:string,block_ref:string,alias:string,line:bigint,key:string>>, block_refs array<string>, body_start bigint, error string"
)


def parse_note(path: str, content: str | None) -> dict:
    """One note's row; a front-matter error leaves all but the path empty."""
    content = content or ""
    row = {"path": path, "content": content, "title": paths.stem(path), "path_key": paths.link_key(path), "stem_key": paths.link_key(paths.stem(path))}
    try:
        fm = frontmatter.parse(content)
    except frontmatter.FrontmatterError as e:
        return row | {"error": str(e), "tags": [], "inline_tags": [], "key_tags": [], "headings": [], "blocks": [], "links": [], "block_refs": [], "body_start": 0}
    s = markdown.structure(content)
    inline = markdown.inline_tags(content, s.code)
    start = frontmatter.split(content)[1]
    return row | {
        "tags": sorted({*frontmatter.string_list(fm, "tags"), *inline}, key=str.encode),
        "inline_tags": inline,
        "key_tags": sorted(set(frontmatter.string_list(fm, "tags")), key=str.encode),
        "frontmatter": None if fm is None else frontmatter.canonical(fm),
        "property_text": frontmatter.search_text(fm),
        "properties": [(k, frontmatter.canonical(v)) for k, v in (fm or {}).items()],
        "items": [(k, [frontmatter.canonical(x) for x in v]) for k, v in (fm or {}).items() if isinstance(v, list)],
        "headings": [h.__dict__ for h in s.headings],
        "blocks": [b.__dict__ for b in s.blocks],
        "links": [x | {"key": paths.link_key(x["target"])} for x in markdown.wikilinks(content, s.code)],
        "block_refs": markdown.block_ids(content, s.code),
        "body_start": len(content[:start].encode()),
        "error": None,
    }


def parse(notes: DataFrame) -> DataFrame:
    """Rows of SCHEMA for (path, content); notes with broken front matter carry an error."""

    def of(batches):
        for batch in batches:
            for n in range(0, batch.num_rows, PART_NOTES):
                b = batch.slice(n, PART_NOTES)
                rows = [parse_note(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return notes.select("path", "content").mapInArrow(of, SCHEMA)


def indexed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("path", "error")


def source_revision(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def stats(parsed: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Notes, files, distinct lower-case tags, links, bytes and excluded files; others has (class, size) of the rest."""
    own = parsed.select(
        F.lit("note").alias("class"), F.octet_length("content").cast("long").alias("size"), F.size("links").cast("long").alias("links"), F.transform("tags", F.lower).alias("tags")
    )
    if others is not None:
        own = own.unionByName(others.select("class", "size"), allowMissingColumns=True)
    totals = own.agg(
        F.count_if(F.col("class") == "note").alias("notes"), F.count_if(F.col("class") != "excluded").alias("files"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
        F.coalesce(F.sum(F.when(F.col("class") != "excluded", F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("class") == "excluded").alias("excluded"),
    )
    tags = own.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tags"))
    return totals.join(F.broadcast(tags)).select("notes", "files", "tags", "links", "bytes", "excluded")


# predicates over parsed notes


def has_tag(tag: str) -> Column:
    want = tag.removeprefix("#").lower()
    return F.exists("tags", lambda t: F.lower(t) == want)


def under_tag(tag: str) -> Column:
    want = tag.removeprefix("#").lower()
    return F.exists("tags", lambda t: (F.lower(t) == want) | F.startswith(F.lower(t), F.lit(want + "/")))


def property_exists(key: str) -> Column:
    return F.map_contains_key("properties", key)


def property_equals(key: str, value) -> Column:
    """The property equals the JSON value, or is an array that holds it."""
    own, want = F.element_at("properties", key), frontmatter.canonical(value)
    return F.coalesce((own == want) | F.array_contains(F.element_at("items", key), want), F.lit(False))


def property_contains(key: str, value) -> Column:
    """Arrays: an item equals the value. Texts with a text: part of it. Otherwise equality."""
    own, want = F.element_at("properties", key), frontmatter.canonical(value)
    within = F.lit(False)
    if isinstance(value, str):
        within = F.startswith(own, F.lit('"')) & F.contains(F.get_json_object(F.concat(F.lit('{"v":'), own, F.lit("}")), "$.v"), F.lit(value))
    return F.coalesce(F.when(F.startswith(own, F.lit("[")), F.array_contains(F.element_at("items", key), want)).otherwise((own == want) | within), F.lit(False))


def heading_page(tree: DataFrame, parsed: DataFrame, offset: int = 0, limit: int = 100, max_bytes: int = 65_536, preview: int = 256) -> DataFrame:
    """A page of one note's heading rows: those from `offset` on, `limit` and max_bytes of text at most (the first always), each with the start of its section."""
    from pyspark.sql import Window

    text = F.encode("content", "UTF-8")
    cut = lambda a, b: F.substring(F.try_validate_utf8(F.decode(F.substring(text, a + 1, b - a), "UTF-8")), 1, preview)
    rows = tree.where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit)).join(parsed.select("path", "content"), "path")
    rows = rows.withColumn("preview", cut(F.col("start").cast("int"), F.col("section_end").cast("int"))).drop("content")
    size = F.octet_length(F.concat("text", "preview")).cast("long")
    upto = F.sum(size).over(Window.partitionBy("path").orderBy("ordinal"))
    return rows.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("ordinal") == offset)).drop("upto").orderBy("ordinal")


def heading_tree(parsed: DataFrame) -> DataFrame:
    """One row per heading: ordinal, parent (nearest earlier heading of a lower level) and where its section ends."""
    size = F.octet_length("content").cast("long")
    at = parsed.select("path", size.alias("size"), "headings", F.posexplode("headings").alias("ordinal", "h"))
    before = F.filter(F.slice("headings", 1, F.col("ordinal")), lambda x: x["level"] < F.col("h.level"))
    parents = F.array_max(F.transform(before, lambda x: F.array_position("headings", x).cast("int") - 1))
    after = F.filter("headings", lambda x: (x["offset"] > F.col("h.offset")) & (x["level"] <= F.col("h.level")))
    return at.select("path", "ordinal", F.col("h.level").alias("level"), F.col("h.text").alias("text"), F.col("h.line").alias("line"), parents.alias("parent"), F.col("h.offset").alias("start"), F.coalesce(F.array_min(F.transform(after, lambda x: x["offset"])), "size").alias("section_end"))
