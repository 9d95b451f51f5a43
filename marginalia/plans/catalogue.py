"""Registry of the queries and of their SQL twins.

Corpora: `notes` are documents as they are, `synth` are Markdown notes composed from the tables' columns.
The SQL derives its truth from the columns, never by parsing the composed Markdown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import config
from marginalia.functions import chunker, frontmatter, markdown, paths, periodic
from marginalia.operators import access, graph, incremental, lexical, notes, postings, search, vectors
from marginalia.session import shared_dir, table
from marginalia.sources import adapters, folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def docs(spark, sf_dir) -> DataFrame:
    return adapters.documents_as_notes(table(spark, sf_dir, "documents"))


def synth(spark, sf_dir) -> DataFrame:
    return adapters.composed_notes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_held: dict[str, str] = {}


def held(spark, sf_dir, name: str, build: Callable[[str], None]) -> str:
    """A folder that build(path) has filled from the tables of sf_dir; made once a session for each state of the tables."""
    state = [spark.sparkContext.applicationId, sf_dir, name]
    for t in ("documents", "labels"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        state += [found.getModificationTime(), found.getLen()]
    key = hashlib.sha256(repr(state).encode()).hexdigest()[:24]
    if key not in _held:
        path = f"{shared_dir(spark)}/held-{name}-{key}"
        build(path)
        _held[key] = path
    return _held[key]


def parsed(spark, sf_dir) -> DataFrame:
    """The composed notes as an open vault holds them: parsed once into a table on the shared folder."""
    path = held(spark, sf_dir, "parsed", lambda p: notes.parse(synth(spark, sf_dir)).write.parquet(p))
    return notes.indexed(spark.read.schema(notes.SCHEMA).parquet(path))


def _plain(df: DataFrame) -> DataFrame:
    """Notes as they are, as a corpus whose only field is the body."""
    none = F.array().cast("array<string>")
    return df.select("path", *[none.alias(f) for f in ("title", "headings", "frontmatter")], lexical.tokens(F.col("content")).alias("body"), none.alias("facets"))


def index(spark, sf_dir, kind: str) -> postings.PostingIndex:
    """The index over the notes (docs), the composed notes (synth) or the composed notes' stems (stems)."""
    def build(path):
        corpus = _plain(docs(spark, sf_dir)) if kind == "docs" else lexical.fields(parsed(spark, sf_dir))
        postings.PostingIndex.build(corpus, path, kind == "stems")

    return postings.PostingIndex(spark, held(spark, sf_dir, f"index-{kind}", build), kind == "stems")


def rounded(name: str = "score"):
    return F.round(F.col(name).cast("double"), 6).alias(name)


DOCS = "notes AS (SELECT doc_id, lang, source, source || '/doc-' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents)"
SYNTH = """
base AS (
  SELECT d.doc_id AS id, lang, source, quality, text, doc_id % 10 = 9 AS shared, doc_id % 5 <> 3 AS linked,
    CASE WHEN d.doc_id % 10 = 9 THEN 'shared-' || ((d.doc_id // 10) % 20) ELSE 'doc-' || d.doc_id END AS stem
  FROM documents d LEFT JOIN (SELECT doc_id AS lid, quality FROM labels) l ON l.lid = d.doc_id),
synth AS (SELECT *, source || '/' || CASE WHEN shared THEN id || '/' ELSE '' END || stem || '.md' AS path FROM base),
links AS (
  SELECT path AS source_path, id, 'doc-' || ((id * 7 + 1) % 997) AS target, 'doc-' || ((id * 7 + 1) % 997) AS raw, NULL AS alias, NULL AS heading FROM synth WHERE linked
  UNION ALL SELECT path, id, 'missing-' || id, 'missing-' || id || '|lost', 'lost', NULL FROM synth WHERE linked AND id % 4 = 0
  UNION ALL SELECT path, id, 'shared-' || (id % 20), 'shared-' || (id % 20) || '#Doc', NULL, 'Doc' FROM synth WHERE linked AND id % 6 = 0),
stems AS (SELECT stem, min(path) AS path FROM synth GROUP BY stem HAVING count(*) = 1),
resolved AS (SELECT l.*, s.path AS resolved FROM links l LEFT JOIN stems s ON s.stem = l.target)"""
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(fields: dict[str, tuple[str, float]], terms: list[str], corpus: str = "notes") -> str:
    """CTEs that end in scores(path, score): fields are (expression, boost)."""
    rows = " UNION ALL ".join(f"SELECT path, '{f}' AS field, {boost}::DOUBLE AS boost, {TOKENS.format(e)} AS ts FROM {corpus}" for f, (e, boost) in fields.items())
    words = ", ".join(f"('{t}')" for t in terms)
    return f"""
tok AS ({rows}),
dl AS (SELECT path, field, boost, len(ts) AS dl, ts FROM tok),
av AS (SELECT field, avg(dl) AS av, count(*) AS n FROM dl GROUP BY field),
terms(term) AS (VALUES {words}),
tf AS (SELECT path, field, boost, dl, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM dl, terms),
df AS (SELECT field, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY field, term),
scores AS (
  SELECT path, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score
  FROM tf JOIN df USING (field, term) JOIN av USING (field) WHERE tf > 0 GROUP BY path)"""


_BODY = {"body": ("content", 1.0)}
_SYNTH_TEXT = r"""regexp_replace(text, '[^\p{L} ]', ' ', 'g')"""
_SYNTH_BODY = f"""'Doc ' || id || ' ' || {_SYNTH_TEXT} || ' ' || CASE id % 3 WHEN 1 THEN 'Notes noted' WHEN 2 THEN 'Notes noted Detail detailed' ELSE '' END || ' Filed batch b' || (id % 5)
 || CASE WHEN linked THEN ' See doc ' || ((id * 7 + 1) % 997) ELSE '' END || CASE WHEN linked AND id % 4 = 0 THEN ' And missing ' || id || ' lost' ELSE '' END || CASE WHEN linked AND id % 6 = 0 THEN ' Or shared ' || (id % 20) || ' Doc' ELSE '' END"""
_SYNTH_FIELDS = {
    "title": ("stem", 5.0),
    "headings": ("'Doc ' || id || CASE id % 3 WHEN 1 THEN ' Notes' WHEN 2 THEN ' Notes Detail' ELSE '' END", 3.0),
    "frontmatter": ("'tags ' || lang || ' corpus ' || source || ' doc ' || id || coalesce(' quality ' || quality, '')", 2.0),
    "body": (_SYNTH_BODY, 1.0),
}


# the corpus: statistics, revisions, parsing


@query(f"""WITH {SYNTH},
sized AS (SELECT strlen('---' || chr(10) || 'tags: [' || lang || ', corpus/' || source || ']' || chr(10) || 'doc: ' || id || coalesce(chr(10) || 'quality: ' || quality, '') || chr(10) || '---' || chr(10) || '# Doc ' || id || repeat(chr(10), 2)
  || {_SYNTH_TEXT} || repeat(chr(10), 2)
  || CASE id % 3 WHEN 1 THEN '## Notes' || repeat(chr(10), 2) || 'noted' || repeat(chr(10), 2) WHEN 2 THEN '## Notes' || repeat(chr(10), 2) || 'noted' || repeat(chr(10), 2) || '### Detail' || repeat(chr(10), 2) || 'detailed' || repeat(chr(10), 2) ELSE '' END
  || 'Filed #batch/b' || (id % 5) || chr(10)) AS n FROM synth),
lines AS (SELECT sum(CASE WHEN alias IS NOT NULL THEN 4 WHEN heading IS NOT NULL THEN 3 ELSE 4 END + strlen(raw) + 5) AS n FROM links)
SELECT (SELECT count(*) FROM synth) AS notes, (SELECT count(*) FROM synth) AS files,
  (SELECT count(DISTINCT t) FROM (SELECT lower(lang) AS t FROM synth UNION ALL SELECT 'corpus/' || lower(source) FROM synth UNION ALL SELECT 'batch/b' || (id % 5) FROM synth)) AS tags,
  (SELECT count(*) FROM links) AS links, CAST((SELECT sum(n) FROM sized) + (SELECT n FROM lines) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS excluded""")
def vault_stats(spark, sf_dir):
    return notes.stats(parsed(spark, sf_dir))


@query(f"WITH {DOCS} SELECT path, sha256(content) AS revision FROM notes")
def source_revision(spark, sf_dir):
    return docs(spark, sf_dir).select("path", notes.source_revision(F.col("content")).alias("revision"))


@query(f"""WITH {SYNTH} SELECT path, list_aggregate(list_sort([lang, 'corpus/' || source]), 'string_agg', ',') AS tags FROM synth""")
def fm_tags(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", F.array_join("key_tags", ",").alias("tags"))


@query(f"""WITH {SYNTH} SELECT path FROM synth WHERE lower(lang) = 'en'""")
def tag_exact(spark, sf_dir):
    return parsed(spark, sf_dir).where(notes.has_tag("#EN")).select("path")


@query(f"""WITH {SYNTH} SELECT path FROM synth WHERE 'corpus/' || source LIKE 'corpus/%'""")
def tag_prefix(spark, sf_dir):
    return parsed(spark, sf_dir).where(notes.under_tag("corpus")).select("path")


@query(f"""WITH {SYNTH} SELECT path FROM synth WHERE quality = 1""")
def fm_eq(spark, sf_dir):
    return parsed(spark, sf_dir).where(notes.property_equals("quality", 1)).select("path")


@query(f"""WITH {SYNTH} SELECT path FROM synth WHERE source = 'src1'""")
def fm_contains(spark, sf_dir):
    return parsed(spark, sf_dir).where(notes.property_contains("tags", "corpus/src1")).select("path")


@query(f"""WITH {SYNTH} SELECT path FROM synth WHERE quality IS NOT NULL""")
def fm_exists(spark, sf_dir):
    return parsed(spark, sf_dir).where(notes.property_exists("quality")).select("path")


@query(r"""WITH notes AS (SELECT source || '/doc-' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents)
SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?m)(?:^|[ \t])#([a-zA-Z][\w/-]*)', 1))), ',') AS tags FROM notes""")
def inline_tags(spark, sf_dir):
    found = notes.parse(docs(spark, sf_dir).where(F.contains("content", F.lit("#")))).select("path", "inline_tags")
    return docs(spark, sf_dir).select("path").join(found, "path", "left").select("path", F.coalesce(F.array_join("inline_tags", ","), F.lit("")).alias("tags"))


@query(f"""WITH {SYNTH} SELECT source_path AS path, raw, target, heading, alias FROM links""")
def wikilink_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", F.explode("links").alias("l")).select("path", "l.raw", "l.target", "l.heading", "l.alias")


_MARKED = """marked AS (SELECT source || '/doc-' || doc_id || '.md' AS path, doc_id AS id,
  '# Top ' || doc_id || chr(10) || 'first ^a' || doc_id || chr(10) || '## Part' || chr(10) || repeat('x', CAST(doc_id % 7 AS INTEGER)) || ' two ^b-' || (doc_id % 5) || chr(10) || '## Rest' || chr(10) || '`code ^no`' || chr(10) AS content FROM documents)"""


def _marked(spark, sf_dir) -> DataFrame:
    """Notes with block ids and nested headings."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.concat(F.lit("# Top "), n, F.lit("\nfirst ^a"), n, F.lit("\n## Part\n"), F.repeat(F.lit("x"), (n % 7).cast("int")), F.lit(" two ^b-"), n % 5, F.lit("\n## Rest\n`code ^no`\n"))
    return d.select(F.concat("source", F.lit("/doc-"), n, F.lit(".md")).alias("path"), text.alias("content"))


@query(f"""WITH {_MARKED} SELECT path, 'a' || id || ',b-' || (id % 5) AS ids FROM marked""")
def block_refs(spark, sf_dir):
    return notes.indexed(notes.parse(_marked(spark, sf_dir))).select("path", F.array_join("block_refs", ",").alias("ids"))


@query(f"""WITH {_MARKED} SELECT path, '# Top ' || id || '|## Part|## Rest' AS headings, 'a' || id || '|b-' || (id % 5) AS blocks FROM marked
UNION ALL SELECT path, '# Doc ' || id || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '|## Notes' ELSE '|## Notes|### Detail' END, 'tags|doc' || CASE WHEN quality IS NULL THEN '' ELSE '|quality' END FROM (
  SELECT *, 'synth/' || source || '/' || CASE WHEN shared THEN id || '/' ELSE '' END || stem || '.md' AS path FROM (
    SELECT doc_id AS id, source, quality, doc_id % 10 = 9 AS shared, CASE WHEN doc_id % 10 = 9 THEN 'shared-' || ((doc_id // 10) % 20) ELSE 'doc-' || doc_id END AS stem
    FROM documents LEFT JOIN (SELECT doc_id AS lid, quality FROM labels) l ON lid = doc_id))""")
def document_maps(spark, sf_dir):
    """Headings with the block ids of the marked notes, and with the front-matter keys of the composed ones."""
    def shown(key):
        return F.udf(lambda c: "|".join(markdown.document_map(c)[key]), "string", useArrow=True)("content")

    marked = _marked(spark, sf_dir).select("path", shown("headings").alias("headings"), shown("blocks").alias("blocks"))
    return marked.unionByName(synth(spark, sf_dir).select(F.concat(F.lit("synth/"), "path").alias("path"), shown("headings").alias("headings"), shown("frontmatter_keys").alias("blocks")))


@query(f"""WITH {_MARKED} SELECT path, CAST(strpos(content, '## Part') + 7 AS BIGINT) AS start, CAST(strpos(content, '## Rest') - 1 AS BIGINT) AS "end" FROM marked""")
def section_ranges(spark, sf_dir):
    """Where the section of a nested heading begins and ends, whatever its case."""
    found = F.udf(lambda c: markdown.section_range(c, f"{c[2 : c.index(chr(10))]}::PART"), "array<bigint>", useArrow=True)("content")
    return _marked(spark, sf_dir).select("path", found.alias("r")).select("path", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


@query(f"""WITH {_MARKED} SELECT path, CAST(strpos(content, '## Part') + 7 AS BIGINT) AS start, CAST(strpos(content, '## Rest') - 2 AS BIGINT) AS "end" FROM marked""")
def block_ranges(spark, sf_dir):
    found = F.udf(lambda c: markdown.find_block(c, "b-" + c.split("^b-")[1][0])[:2], "array<bigint>", useArrow=True)("content")
    return _marked(spark, sf_dir).select("path", found.alias("r")).select("path", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


@query(f"""WITH {_MARKED} SELECT path, sha256(replace(content, repeat('x', CAST(id % 7 AS INTEGER)) || ' two ^b-', 'new ^b-')) AS revision FROM marked""")
def patch_block(spark, sf_dir):
    put = F.udf(lambda c: markdown.patch(c, "replace", "block", "^b-" + c.split("^b-")[1][0], "new"), "string", useArrow=True)
    return _marked(spark, sf_dir).select("path", notes.source_revision(put("content")).alias("revision"))


@query(f"""WITH {SYNTH} SELECT path, 0 AS ordinal, 1 AS level, 'Doc ' || id AS text, NULL::INTEGER AS parent FROM synth
UNION ALL SELECT path, 1, 2, 'Notes', 0 FROM synth WHERE id % 3 <> 0 UNION ALL SELECT path, 2, 3, 'Detail', 1 FROM synth WHERE id % 3 = 2""")
def heading_tree(spark, sf_dir):
    return notes.heading_tree(parsed(spark, sf_dir)).select("path", "ordinal", "level", "text", "parent")


# links


@query(f"""WITH {SYNTH} SELECT DISTINCT target, resolved FROM resolved""")
def link_resolve(spark, sf_dir):
    return graph.resolved(parsed(spark, sf_dir)).select("target", "resolved").distinct()


@query(f"""WITH {SYNTH} SELECT stem AS stem_key, path FROM synth WHERE stem IN (SELECT stem FROM synth GROUP BY stem HAVING count(*) > 1)""")
def link_candidates(spark, sf_dir):
    return graph.candidates(parsed(spark, sf_dir))


@query(f"""WITH {SYNTH} SELECT DISTINCT resolved AS target, source_path AS source FROM resolved WHERE resolved IS NOT NULL""")
def backlink_edges(spark, sf_dir):
    return graph.edges(graph.resolved(parsed(spark, sf_dir)))


@query(f"""WITH {SYNTH}, hub AS (SELECT resolved AS p FROM resolved WHERE resolved IS NOT NULL GROUP BY resolved ORDER BY count(DISTINCT source_path) DESC, resolved LIMIT 1)
SELECT source_path AS source, count(*) AS refs FROM resolved, hub WHERE resolved = p GROUP BY source_path""")
def backlinks(spark, sf_dir):
    found = graph.resolved(parsed(spark, sf_dir))
    hub = graph.edges(found).groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()
    return graph.backlinks(found, hub["target"] if hub else "").select("source", F.size("refs").cast("long").alias("refs"))


@query(f"""WITH {SYNTH}, own AS (SELECT source_path AS p FROM resolved GROUP BY source_path ORDER BY count(*) DESC, source_path LIMIT 1)
SELECT source_path AS source, target, resolved FROM resolved, own WHERE source_path = p""")
def outgoing(spark, sf_dir):
    found = graph.resolved(parsed(spark, sf_dir))
    most = found.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()
    return graph.outgoing(found, most["source"] if most else "").select(F.lit(most["source"] if most else "").alias("source"), "target", "resolved")


@query(f"""WITH {SYNTH} SELECT source_path AS source, raw, target FROM resolved WHERE resolved IS NULL""")
def broken_links(spark, sf_dir):
    return graph.broken(graph.resolved(parsed(spark, sf_dir))).select("source", "raw", "target")


_ORPHANS = """alone AS (SELECT path FROM {synth} WHERE path NOT IN (SELECT resolved FROM {resolved} WHERE resolved IS NOT NULL)),
outs AS (SELECT source_path, bool_or(resolved IS NOT NULL) AS reaches, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM {resolved} GROUP BY source_path)
SELECT path, CASE WHEN targets IS NULL THEN 'no_links' ELSE 'broken_outgoing_only' END AS kind, coalesce(targets, '') AS targets
FROM alone LEFT JOIN outs ON source_path = path WHERE targets IS NULL OR NOT reaches"""


@query(f"WITH {SYNTH}, " + _ORPHANS.format(synth="synth", resolved="resolved"))
def orphans(spark, sf_dir):
    own = parsed(spark, sf_dir)
    return graph.orphans(own, graph.resolved(own)).select("path", "kind", F.array_join("targets", ",").alias("targets"))


@query(f"""WITH {SYNTH}, back AS (SELECT resolved, count(DISTINCT source_path) AS n FROM resolved WHERE resolved IS NOT NULL GROUP BY resolved)
SELECT path, stem AS title, coalesce(n, 0) AS backlinks FROM synth LEFT JOIN back ON resolved = path""")
def note_inspect(spark, sf_dir):
    own = parsed(spark, sf_dir)
    return graph.backlink_counts(own, graph.resolved(own)).select("path", "title", "backlinks")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT h.page_id, h.href, p.page_id AS target FROM h LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = h.href""")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = pages.groupBy("url").agg(F.min("page_id").alias("target"))
    return hrefs.join(known, F.col("href") == F.col("url"), "left").select("page_id", "href", "target")


# lexical search


@query(f"WITH {SYNTH}," + _bm25_sql(_SYNTH_FIELDS, ["doc", "the", "detail", "src1"], "synth") + "SELECT path, round(score, 6) AS score FROM scores ORDER BY score DESC, path LIMIT 20")
def bm25_default(spark, sf_dir):
    return index(spark, sf_dir, "synth").search("doc the detail src1", 20, digits=6).select("path", rounded())


@query(f"WITH {SYNTH}," + _bm25_sql({k: _SYNTH_FIELDS[k] for k in ("title", "headings")}, ["doc", "notes"], "synth") + """,
facets AS (SELECT path, CASE WHEN source = 'src2' THEN 4.0 ELSE 0 END AS f FROM synth)
SELECT path, round(coalesce(score, 0) + f, 6) AS score FROM facets LEFT JOIN scores USING (path) WHERE coalesce(score, 0) + f > 0 ORDER BY coalesce(score, 0) + f DESC, path LIMIT 20""")
def bm25_fields(spark, sf_dir):
    own = index(spark, sf_dir, "synth")
    text = own.scores(["doc", "notes"], {k: lexical.BOOSTS[k] for k in ("title", "headings")})
    both = text.unionByName(own.facet_scores(["corpus/src2"])).groupBy("path").agg(F.sum("score").alias("score"))
    return lexical.top(both, 20).select("path", rounded())


@query(rf"""WITH {DOCS}, words(w) AS (VALUES ('thing'), ('ferom')),
hits AS (SELECT path, CAST(sum(CASE WHEN len(list_filter(ts, lambda x: damerau_levenshtein(x, w) <= 1)) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score
  FROM (SELECT path, list_distinct({TOKENS.format("content")}) AS ts FROM notes), words GROUP BY path)
SELECT path, round(score, 6) AS score FROM hits WHERE score > 0 ORDER BY score DESC, path LIMIT 20""")
def bm25_fuzzy(spark, sf_dir):
    return lexical.top(index(spark, sf_dir, "docs").fuzzy_scores(["thing", "ferom"], {"body": 1.0}), 20).select("path", rounded())


def _body_scores(spark, sf_dir, terms):
    return index(spark, sf_dir, "docs").scores(terms, {"body": 1.0})


@query(f"WITH {DOCS}," + _bm25_sql(_BODY, ["the", "from"]) + "SELECT path, round(score, 6) AS score FROM scores WHERE path LIKE 'src1/%' ORDER BY score DESC, path LIMIT 20")
def bm25_allowed(spark, sf_dir):
    allowed = docs(spark, sf_dir).where(F.startswith("path", F.lit("src1/"))).select("path")
    return lexical.top(_body_scores(spark, sf_dir, ["the", "from"]), 20, allowed, 6).select("path", rounded())


@query(f"WITH {DOCS}," + _bm25_sql(_BODY, ["the", "from"]) + """, hits AS (SELECT path, score FROM scores ORDER BY score DESC, path LIMIT 50), ends AS (SELECT min(score) AS lo, max(score) AS hi FROM hits)
SELECT path, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM hits, ends""")
def bm25_minmax(spark, sf_dir):
    return lexical.normalized(lexical.top(_body_scores(spark, sf_dir, ["the", "from"]), 50)).select("path", rounded())


@query(f"""WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format("content")})) AS term FROM notes) GROUP BY term""")
def term_df(spark, sf_dir):
    return lexical.term_statistics(docs(spark, sf_dir).select("path", lexical.tokens(F.col("content")).alias("body")))


# The forms of the three words that occur, with their stems.
_FORMS = {"detail": ("detail", "details", "detailed", "detailing"), "note": ("note", "notes", "noted", "noting"), "file": ("file", "files", "filed", "filing")}
_STEM = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(f) for f in forms)}) THEN '{stem}'" for stem, forms in _FORMS.items()) + " ELSE w END"


@query(f"WITH {SYNTH}," + _bm25_sql(_SYNTH_FIELDS, list(_FORMS), "synth").replace(
    "dl AS (SELECT path, field, boost, len(ts) AS dl, ts FROM tok)",
    f"stems AS (SELECT path, field, boost, list_transform(list_filter(ts, lambda w: strlen(w) < 40), lambda w: {_STEM}) AS ts FROM tok), dl AS (SELECT path, field, boost, len(ts) AS dl, ts FROM stems)",
).replace("stems AS (SELECT path, field", "cut AS (SELECT path, field").replace("FROM stems)", "FROM cut)") + "SELECT path, round(score, 6) AS score FROM scores ORDER BY score DESC, path LIMIT 20")
def bm25_stemmed(spark, sf_dir):
    return index(spark, sf_dir, "stems").search("detailed noting files", 20, digits=6).select("path", rounded())


_HAS = "list_contains({0}, '{1}')"
_DOC_TOKENS = f"tokens AS (SELECT path, {TOKENS.format('content')} AS ts FROM notes)"


@query(f"WITH {DOCS}," + _bm25_sql(_BODY, ["licensed", "under"]) + f""", {_DOC_TOKENS}
SELECT path, round(score, 6) AS score FROM scores JOIN tokens USING (path) WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' licensed under ') ORDER BY scores.score DESC, path LIMIT 20""")
def query_phrase(spark, sf_dir):
    return index(spark, sf_dir, "docs").search('"licensed under"', 20).select("path", rounded())


@query(f"WITH {DOCS}," + _bm25_sql(_BODY, ["the", "an", "thing", "clown"]) + f""", {_DOC_TOKENS}
SELECT path, round(score, 6) AS score FROM scores JOIN tokens USING (path)
WHERE {_HAS.format("ts", "the")} AND NOT {_HAS.format("ts", "idiot")} AND (({_HAS.format("ts", "an")} AND {_HAS.format("ts", "thing")}) OR {_HAS.format("ts", "clown")}) ORDER BY scores.score DESC, path LIMIT 50""")
def query_boolean(spark, sf_dir):
    return index(spark, sf_dir, "docs").search("+the -idiot +((an AND thing) OR body:clown)", 50).select("path", rounded())


_REPLACED = DOCS.replace("coalesce(text, '') AS content FROM documents)", "CASE WHEN doc_id % 50 = 0 THEN 'replaced the note the' ELSE coalesce(text, '') END AS content FROM documents WHERE doc_id % 50 = 0 OR doc_id % 97 <> 1)")


@query(f"WITH {_REPLACED}," + _bm25_sql(_BODY, ["the", "replaced"]) + "SELECT path, round(score, 6) AS score FROM scores")
def index_replaced(spark, sf_dir):
    """Notes replaced and removed by path in a later segment: statistics and scores are those of what is left."""
    own = docs(spark, sf_dir)

    def build(path):
        made = postings.PostingIndex.build(_plain(own), path)
        again = own.where(F.col("doc_id") % 50 == 0).withColumn("content", F.lit("replaced the note the"))
        made.replace(_plain(again), own.where((F.col("doc_id") % 97 == 1) & (F.col("doc_id") % 50 != 0)).select("path"))

    made = postings.PostingIndex(spark, held(spark, sf_dir, "index-replaced", build), False)
    return made.scores(["the", "replaced"], {"body": 1.0}).select("path", rounded())


# regular expressions, listings, budgets


# Texts that only a reading by Unicode's rules finds.
_FOREIGN = (("x/1.md", "une ÉCOLE et une école"), ("x/2.md", "room ４２ and 7.5"), ("x/3.md", "ΔΡΟΜΟΙ δρομοι"), ("x/4.md", "plain ascii"), ("x/5.md", "Straße Ünder"))


def _foreign(spark, sf_dir):
    return docs(spark, sf_dir).select("path", "content").unionByName(spark.createDataFrame(_FOREIGN, "path string, content string"))


_WITH_FOREIGN = "every AS (SELECT path, content FROM notes UNION ALL VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in _FOREIGN) + ")"


@query(rf"""WITH {DOCS}, {_WITH_FOREIGN} SELECT path, CAST(len(regexp_extract_all(content, '\p{{Nd}}+[.]?\p{{Nd}}+')) AS BIGINT) AS matches FROM every WHERE regexp_matches(content, '\p{{Nd}}+[.]?\p{{Nd}}+')""")
def regex_unicode(spark, sf_dir):
    return search.search_regex(_foreign(spark, sf_dir), r"\d+[.]?\p{Nd}+", 1 << 30, 40).select("path", F.size("matches").cast("long").alias("matches"))


@query(f"""WITH {DOCS}, {_WITH_FOREIGN}, q(w) AS (VALUES ('école'), ('δρομοι'), ('ünder')), hits AS (SELECT w, path, lower(content) AS c FROM every, q WHERE contains(lower(content), w))
SELECT w AS query, path, CAST((length(c) - length(replace(c, w, ''))) / length(w) AS BIGINT) AS matches FROM hits""")
def literal_unicode(spark, sf_dir):
    out = None
    for q in ("École", "δρομοι", "ÜNDER"):
        got = search.search_literal(_foreign(spark, sf_dir), q, 1 << 30, 10).select(F.lit(q.lower()).alias("query"), "path", F.size("matches").cast("long").alias("matches"))
        out = got if out is None else out.unionByName(got)
    return out


@query(rf"""WITH {DOCS} SELECT path, context, start, "end", line FROM (
  SELECT path, unnest(range(1, len(parts))) AS i, parts, content FROM (SELECT path, content, string_split(content, 'Licensed under') AS parts FROM notes)) t,
LATERAL (SELECT substr(array_to_string(parts[1:i], 'Licensed under'), greatest(1, length(array_to_string(parts[1:i], 'Licensed under')) - 9)) AS l, substr(array_to_string(parts[i + 1:], 'Licensed under'), 1, 10) AS r, array_to_string(parts[1:i], 'Licensed under') AS before) x,
LATERAL (SELECT l || 'Licensed under' || r AS context, CAST(length(l) AS BIGINT) AS start, CAST(length(l) + 14 AS BIGINT) AS "end", CAST(length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS line) y
WHERE strlen(l) = length(l) AND strlen(r) = length(r)""")
def match_contexts(spark, sf_dir):
    """Context, place and line of every match whose context is plain ASCII (there bytes are characters)."""
    found = search.search_regex(docs(spark, sf_dir), "Licensed under", 1 << 30, 10)
    rows = found.select("path", F.explode("matches").alias("m")).select("path", "m.*")
    return rows.where(F.octet_length("context") == F.char_length("context"))


@query(rf"""WITH {DOCS} SELECT path, CAST(len(regexp_extract_all(content, '[a-z]+@[a-z0-9]+|[0-9]+[.][0-9]+')) AS BIGINT) AS matches FROM notes WHERE regexp_matches(content, '[a-z]+@[a-z0-9]+|[0-9]+[.][0-9]+') ORDER BY path LIMIT 20""")
def regex_search(spark, sf_dir):
    found = search.search_regex(docs(spark, sf_dir), "[a-z]+@[a-z0-9]+|[0-9]+[.][0-9]+", 20, 40)
    return found.select("path", F.size("matches").cast("long").alias("matches"))


@query(rf"""WITH {DOCS} SELECT path, CAST(len(regexp_extract_all(content, '(?i)licensed under')) AS BIGINT) AS matches FROM notes WHERE contains(lower(content), 'licensed under') ORDER BY path LIMIT 20""")
def literal_search(spark, sf_dir):
    found = search.search_literal(docs(spark, sf_dir), "LICENSED under", 20)
    return found.select("path", F.size("matches").cast("long").alias("matches"))


@query(f"""WITH {DOCS} SELECT path, path LIKE 'src1/%' OR path LIKE '%/doc-1_.md' OR path LIKE '%7.md' AS excluded FROM notes""")
def exclude_globs(spark, sf_dir):
    rules = paths.exclusion_rules(["src1/", "**/doc-1?.md"], ["*7.md", "src1/"])
    return docs(spark, sf_dir).select("path", folder.excluded(F.col("path"), rules).alias("excluded"))


@query(f"""WITH {DOCS} SELECT DISTINCT source AS path, 'directory' AS kind FROM notes""")
def list_depth(spark, sf_dir):
    return search.listing(docs(spark, sf_dir), recursive=True, max_depth=1).select("path", "kind")


@query(f"""WITH {SYNTH} SELECT path, stem AS title, CAST(CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS headings FROM synth WHERE source = 'src1'
UNION ALL SELECT DISTINCT source || '/' || id, NULL, NULL FROM synth WHERE shared AND source = 'src1'""")
def list_metadata(spark, sf_dir):
    files = search.listing(synth(spark, sf_dir).select("path"), "src1", recursive=True)
    own = parsed(spark, sf_dir).select("path", "title", F.size("headings").alias("headings"))
    return files.join(own, "path", "left").select("path", "title", "headings")


@query(f"""WITH {DOCS}, entries AS (SELECT path, string_split(path, '/') AS parts FROM notes UNION ALL SELECT DISTINCT source, [source] FROM notes),
tops AS (SELECT *, row_number() OVER (PARTITION BY len(parts), parts[1:len(parts) - 1] ORDER BY parts DESC) = 1 AS last FROM entries)
SELECT CAST(row_number() OVER (ORDER BY e.parts) - 1 AS BIGINT) AS place,
  CASE WHEN len(e.parts) = 2 THEN CASE WHEN t.last THEN '    ' ELSE '│   ' END ELSE '' END || CASE WHEN e.last THEN '└── ' ELSE '├── ' END || e.parts[len(e.parts)] AS line
FROM tops e LEFT JOIN tops t ON len(e.parts) = 2 AND t.parts = e.parts[1:1]""")
def tree_order(spark, sf_dir):
    entries = [r["path"] for r in search.listing(docs(spark, sf_dir), recursive=True).select("path").collect()]
    return spark.createDataFrame(list(enumerate(search.tree(entries).split("\n"))), "place bigint, line string")


@query(f"""WITH RECURSIVE {DOCS}, firsts AS (SELECT path, CAST(strlen(content) AS BIGINT) AS size, row_number() OVER (ORDER BY path) AS n FROM notes ORDER BY path LIMIT 20),
fold AS (SELECT CAST(0 AS BIGINT) AS n, '' AS path, CAST(0 AS BIGINT) AS size, false AS taken, CAST(20000 AS BIGINT) AS left_over
  UNION ALL SELECT f.n, f.path, f.size, f.size <= left_over, left_over - CASE WHEN f.size <= left_over THEN f.size ELSE 0 END FROM fold JOIN firsts f ON f.n = fold.n + 1)
SELECT fold.path, size, taken, CASE WHEN taken THEN sha256(content) END AS content, CASE WHEN NOT taken THEN CASE WHEN size > 20000 THEN 'larger than the budget' ELSE 'no room left' END END AS skipped FROM fold JOIN notes ON notes.path = fold.path WHERE n > 0""")
def read_many_budget(spark, sf_dir):
    return search.read_many(docs(spark, sf_dir), 20, 20_000).select("path", "size", "taken", F.sha2("content", 256).alias("content"), "skipped")


@query(f"""WITH {DOCS}, firsts AS (SELECT strlen(content) AS size FROM notes ORDER BY path LIMIT 100)
SELECT count(*) AS found, count(*) AS returned, CAST(0 AS BIGINT) AS skipped, CAST(sum(size) AS BIGINT) AS bytes FROM firsts""")
def read_many_counts(spark, sf_dir):
    return search.read_counts(search.read_many(docs(spark, sf_dir), 100, 1 << 40))


@query(r"""SELECT raw, source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM (SELECT *, source || '//./x/../' || lang || '\doc-' || doc_id || '.md' AS raw FROM documents)""")
def path_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat("source", F.lit("//./x/../"), "lang", F.lit("\\doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(raw.alias("raw")).select("raw", F.udf(paths.normalize, "string", useArrow=True)("raw").alias("path"))


@query("""SELECT doc_id, sha256(replace(url_encode(coalesce(text, '')), '%2F', '/')) AS encoded FROM documents""")
def percent_encode(spark, sf_dir):
    encode = F.udf(lambda t: paths.percent_encode(t or ""), "string", useArrow=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(encode("text"), 256).alias("encoded"))


# vectors


def _chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("note-"), F.col("vec_id") % 100, F.lit(".md")).alias("path"), F.col("vec_id").alias("start"), F.col("embedding").alias("vector"))


def _query_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COSINE = "cos AS (SELECT vec_id, 'note-' || (vec_id % 100) || '.md' AS path, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"
_BEST = _COSINE + ", best AS (SELECT path, score, vec_id AS start FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, vec_id) AS rn FROM cos) WHERE rn = 1)"


@query(f"WITH {_COSINE} SELECT vec_id, round(score, 6) AS score FROM cos ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scored = e.select("vec_id", vectors.cosine(F.col("embedding"), _query_vector(spark, sf_dir)).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", rounded())


@query(f"WITH {_BEST} SELECT path, round(score, 6) AS score, start FROM best")
def best_chunk(spark, sf_dir):
    return vectors.best_chunks(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)).select("path", rounded(), "start")


@query(f"WITH {_BEST} SELECT path, round(score, 6) AS score FROM best WHERE CAST(regexp_extract(path, '[0-9]+') AS INTEGER) < 50 ORDER BY best.score DESC, path LIMIT 10")
def semantic_live_only(spark, sf_dir):
    live = _chunks(spark, sf_dir).select("path").distinct().where(F.regexp_extract("path", "[0-9]+", 0).cast("int") < 50)
    return vectors.semantic(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10, live).select("path", rounded())


@query(f"WITH {DOCS}," + _bm25_sql(_BODY, ["the", "from"]) + f""", {_COSINE},
own AS (SELECT n.path, c.score AS cosine FROM notes n JOIN cos c ON c.vec_id = n.doc_id),
hits AS (SELECT path, score FROM scores WHERE path IN (SELECT path FROM own) ORDER BY score DESC, path LIMIT 50), ends AS (SELECT min(score) AS lo, max(score) AS hi FROM hits),
norm AS (SELECT path, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS lexical FROM hits, ends)
SELECT path, round(lexical, 6) AS lexical, round(cosine, 6) AS cosine, round(0.25 * lexical + 0.75 * cosine, 6) AS score FROM norm JOIN own USING (path) ORDER BY 0.25 * lexical + 0.75 * cosine DESC, path LIMIT 10""")
def hybrid_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("start"), F.col("embedding").alias("vector"))
    chunks = docs(spark, sf_dir).select("path", "doc_id").join(e, F.col("doc_id") == F.col("start"))
    hits = lexical.normalized(lexical.top(_body_scores(spark, sf_dir, ["the", "from"]), 50, chunks.select("path")))
    found = vectors.hybrid(hits, vectors.best_chunks(chunks, _query_vector(spark, sf_dir)), 10, 0.25)
    return found.select("path", rounded("lexical"), rounded("cosine"), rounded())


def _edited(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))


_EDITED = "edited AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 0 THEN content || ' edited' ELSE content END AS content FROM notes)"


@query(f"WITH {DOCS}, {_EDITED} SELECT path, sha256(content) IN (SELECT sha256(content) FROM notes) AS reused FROM edited")
def chunk_reuse(spark, sf_dir):
    hashed = lambda df: df.select("path", notes.source_revision(F.col("content")).alias("input_hash"))
    cached = hashed(docs(spark, sf_dir)).withColumn("vector", F.array(F.lit(1.0)))
    return vectors.reuse(hashed(_edited(spark, sf_dir)), cached).select("path", F.col("vector").isNotNull().alias("reused"))


@query(f"WITH {DOCS}, {_EDITED} SELECT n.path, CASE WHEN n.doc_id % 25 = 0 THEN 'unavailable' WHEN n.content = e.content THEN 'current' ELSE 'changed' END AS status FROM notes n JOIN edited e USING (path)")
def evidence_status(spark, sf_dir):
    hits = docs(spark, sf_dir).select("path", notes.source_revision(F.col("content")).alias("revision"))
    now = _edited(spark, sf_dir).where(F.col("doc_id") % 25 != 0).select("path", notes.source_revision(F.col("content")).alias("revision"))
    return vectors.evidence_status(hits, now)


# chunks


_CHUNK = pa.schema([("scope", pa.string()), ("text", pa.string()), ("input_hash", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("overlap_start", pa.int64()), ("heading_path", pa.list_(pa.string())), ("block_kind", pa.string())])


def chunked(df: DataFrame, max_tokens: int = 200) -> DataFrame:
    """One row per chunk of (path, content); notes are taken a few hundred at a time."""

    def of(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = [chunker.chunks(paths.stem(p), c or "", max_tokens) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist())]
                path = b.column("path").take(pa.array([n for n, own in enumerate(found) for _ in own], pa.int64()))
                columns = [pa.array([x[f.name] for own in found for x in own], f.type) for f in _CHUNK]
                yield pa.RecordBatch.from_arrays([path, *columns], names=["path", *_CHUNK.names])

    return df.select("path", "content").mapInArrow(of, "path string, scope string, text string, input_hash string, start bigint, end bigint, overlap_start bigint, heading_path array<string>, block_kind string")


def coverage(chunks: DataFrame) -> DataFrame:
    """Gaps between the chunks of each note, and the bytes that they cover."""
    from pyspark.sql import Window

    by = Window.partitionBy("path").orderBy("start")
    gap = F.when(F.lag("end").over(by) != F.col("start"), 1).otherwise(0)
    return chunks.withColumn("gap", gap).groupBy("path").agg(F.sum("gap").alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query(f"""WITH {DOCS} SELECT path, CAST(0 AS BIGINT) AS gaps, CAST(strlen(content) AS BIGINT) AS bytes FROM notes WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def chunk_coverage(spark, sf_dir):
    return coverage(chunked(docs(spark, sf_dir)))


@query(f"""WITH {SYNTH}, sections AS (
  SELECT path, 'Doc ' || id AS heads FROM synth UNION ALL SELECT path, 'Doc ' || id || ' > Notes' FROM synth WHERE id % 3 <> 0
  UNION ALL SELECT path, 'Doc ' || id || ' > Notes > Detail' FROM synth WHERE id % 3 = 2),
long AS (SELECT path FROM synth WHERE strlen({_SYNTH_TEXT}) > 8 * 420)
SELECT s.path, heads FROM sections s JOIN long USING (path)""")
def chunk_sections(spark, sf_dir):
    """The headings above the chunks of notes too long for one chunk, each once."""
    own = synth(spark, sf_dir).withColumn("c", F.regexp_extract("content", r"\n# Doc \d+\n\n([^\n]*)\n", 1)).where(F.octet_length("c") > 8 * 420)
    return chunked(own).select("path", F.array_join("heading_path", " > ").alias("heads")).distinct()


def _boundaries(chunks: DataFrame, notes_: DataFrame, max_tokens: int) -> DataFrame:
    """How many chunks are over the limit, start inside a character, or could take the next word as well."""
    def of(batches):
        for b in batches:
            out = []
            for path, content, found in zip(*(b.column(c).to_pylist() for c in ("path", "content", "found"))):
                raw, bad = content.encode(), 0
                for x in found:
                    bad += chunker.word_count(x["text"]) > max_tokens or (x["start"] < len(raw) and raw[x["start"]] & 0xC0 == 0x80)
                    bad += not x["text"].encode().endswith(raw[x["start"] : x["end"]])
                out.append((path, len(found), bad))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [(), (), ()], (pa.string(), pa.int64(), pa.int64()))], names=["path", "chunks", "bad"])

    gathered = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("found"))
    return notes_.join(gathered, "path").select("path", "content", "found").mapInArrow(of, "path string, chunks bigint, bad bigint")


@query(f"""WITH {DOCS} SELECT path, CAST(0 AS BIGINT) AS bad FROM notes WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def chunk_boundaries(spark, sf_dir):
    """Every chunk is within the limit, starts at a whole character and ends with exactly its part of the note."""
    return _boundaries(chunked(docs(spark, sf_dir)), docs(spark, sf_dir), 200).select("path", "bad")


@query(f"""WITH RECURSIVE firsts AS (SELECT doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS total
  UNION ALL SELECT f.n, f.doc_id, CASE WHEN items > 0 AND items < 8 AND total + size <= 20000 THEN batch WHEN items = 0 THEN batch ELSE batch + 1 END,
    CASE WHEN items > 0 AND items < 8 AND total + size <= 20000 THEN items + 1 ELSE 1 END, CASE WHEN items > 0 AND items < 8 AND total + size <= 20000 THEN total + size ELSE size END
  FROM fold JOIN firsts f ON f.n = fold.n + 1)
SELECT doc_id, batch FROM fold WHERE n > 0""")
def plan_batches(spark, sf_dir):
    return batches(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size")), 8, 20_000)


def batches(sized: DataFrame, max_items: int, max_size: int) -> DataFrame:
    """doc_id and batch of every row of (doc_id, size): the greedy plan over all rows in order, folded range by range.

    A range may be entered at one of max_items offsets only, as the batch before it reaches no further. Each range is
    folded for each of them, the driver chains those results, a row or so a range, and each range is folded as entered.
    """
    rows = sized.repartitionByRange("doc_id").select("*", F.spark_partition_id().alias("part")).persist()
    def head(t):
        t = t.sort_by("doc_id")
        return pa.table({"part": [t.column("part")[0].as_py()], "size": [t.column("size").to_pylist()[:max_items]]})

    heads = rows.groupBy("part").applyInArrow(head, "part bigint, size array<bigint>")
    parts = sorted(heads.collect(), key=lambda r: r["part"])
    ahead, after = {}, []
    for r in reversed(parts):
        ahead[r["part"]] = after
        after = ([*r["size"], *after])[:max_items]

    def starts(sizes, part, at):
        whole, out = [*sizes, *ahead[part]], []
        while at < len(sizes):
            out.append(at)
            at += chunker.plan_batch(whole[at : at + max_items], max_items, max_size)
        return out, at - len(sizes)

    def tried(t):
        part, sizes = t.column("part")[0].as_py(), t.sort_by("doc_id").column("size").to_pylist()
        found = [(part, at, len(s), over) for at in range(max_items) for s, over in [starts(sizes, part, at)]]
        return pa.table(dict(zip(("part", "at", "many", "over"), map(list, zip(*found)))))

    ways = {(r["part"], r["at"]): (r["many"], r["over"]) for r in rows.groupBy("part").applyInArrow(tried, "part bigint, at bigint, many bigint, over bigint").collect()}
    entered, at, batch = {}, 0, 0
    for r in parts:
        entered[r["part"]] = (at, batch)
        many, at = ways[r["part"], at]
        batch += many

    def planned(t):
        t = t.sort_by("doc_id")
        part = t.column("part")[0].as_py()
        at, batch = entered[part]
        begun = set(starts(t.column("size").to_pylist(), part, at)[0])
        out, now = [], batch - 1
        for k in range(t.num_rows):
            now += k in begun
            out.append(now)
        return pa.table({"doc_id": t.column("doc_id"), "batch": pa.array(out, pa.int64())})

    return rows.groupBy("part").applyInArrow(planned, "doc_id bigint, batch bigint")


# periodic notes and other functions


def _dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, 'journal/' || strftime(d, '%Y/%m/%Y-%m-%d') || '.md' AS daily, printf('%04d-W%02d', isoyear(d), week(d)) AS weekly, strftime(d, '%Y-%m') AS monthly, year(d) || '-Q' || quarter(d) AS quarterly FROM d""")
def periodic_path(spark, sf_dir):
    def named(fmt, folder_=None):
        return F.udf(lambda d: periodic.note_path(d, fmt, folder_) if d else None, "string", useArrow=True)("d")

    plain = {p: F.regexp_replace(named(periodic.DEFAULTS[p]), r"\.md$", "").alias(p) for p in ("weekly", "monthly", "quarterly")}
    return _dates(spark, sf_dir).select("d", named("YYYY/MM/YYYY-MM-DD", "journal").alias("daily"), *plain.values())


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, CAST(date_trunc('week', d) AS DATE) AS week, CAST(date_trunc('month', d) AS DATE) AS month, CAST(date_trunc('quarter', d) AS DATE) AS quarter FROM d""")
def periodic_parse(spark, sf_dir):
    def parser(fmt):
        return F.udf(lambda d: periodic.parse_date(periodic.format_date(d, fmt), fmt) if d else None, "date", useArrow=True)

    return _dates(spark, sf_dir).select("d", *[parser(periodic.DEFAULTS[p])("d").alias(name) for p, name in (("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter"))])


@query("""SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || '.md' AS path FROM orders ORDER BY path DESC LIMIT 10""")
def periodic_recent(spark, sf_dir):
    names = _dates(spark, sf_dir).select(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(".md")).alias("path"))
    read = F.udf(lambda p: periodic.parse_date(p.removesuffix(".md"), periodic.DEFAULTS["daily"]), "date", useArrow=True)
    found = names.withColumn("d", read("path"))
    return found.where("d IS NOT NULL").orderBy(F.desc("d")).limit(10).select("path")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d, '# note ' || strftime(d, '%d.%m.%Y') || ' on ' || strftime(d, '%Y-%m-%d') AS text FROM d""")
def template_expand(spark, sf_dir):
    expand = F.udf(lambda d: periodic.expand_template("# {{title}} {{date:DD.MM.YYYY}} on {{date}}", d, "note"), "string", useArrow=True)
    return _dates(spark, sf_dir).select("d", expand("d").alias("text"))


@query("SELECT CAST(n AS INTEGER) AS attempt, CAST(least(30, pow(2, least(n, 6) - 1)) AS INTEGER) AS delay FROM range(1, 11) t(n)")
def retry_backoff(spark, sf_dir):
    return spark.range(1, 11).select(F.col("id").cast("int").alias("attempt"), F.udf(periodic.retry_delay, "int", useArrow=True)("id").alias("delay"))


_FAILED = "CASE event_id % 5 WHEN 0 THEN 'request_retryable' WHEN 1 THEN 'transient_io' WHEN 2 THEN 'invalid_reply' END"


@query(f"""WITH w AS (SELECT 'event-' || event_id AS path, event_id AS generation, CAST(event_id % 9 AS INTEGER) AS attempt, {_FAILED} AS class, CASE WHEN event_id % 10 = 0 THEN 45.0::DOUBLE END AS ra FROM events),
n AS (SELECT *, attempt + CASE WHEN class IS NULL THEN 0 ELSE 1 END AS tried FROM w)
SELECT path, CASE WHEN class = 'invalid_reply' THEN 'failed' ELSE 'upsert' END AS kind, generation, CAST(tried AS INTEGER) AS attempt,
  CASE WHEN class IN ('request_retryable', 'transient_io') THEN 100.0 + greatest(least(30.0, pow(2.0, least(greatest(tried, 1), 6) - 1)), coalesce(ra, 0.0)) ELSE 0.0 END AS not_before FROM n""")
def retry_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path, n = F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("path"), F.col("event_id")
    work = e.select(path, F.lit("upsert").alias("kind"), n.alias("generation"), (n % 9).cast("int").alias("attempt"), F.lit(0.0).alias("not_before"))
    failures = e.where(n % 5 < 3).select(path, F.get(F.array(*map(F.lit, ("request_retryable", "transient_io", "invalid_reply"))), (n % 5).cast("int")).alias("class"), F.when(n % 10 == 0, 45.0).alias("retry_after"))
    return incremental.after_failures(work, failures, 100.0)


@query(f"""WITH {DOCS}, wanted AS (SELECT path || '#Part ' || doc_id AS target, path, 'Part ' || doc_id AS subpath, doc_id % 7 <> 0 AS there FROM notes WHERE doc_id % 2 = 0
  UNION ALL SELECT path, path, NULL, doc_id % 7 <> 0 FROM notes WHERE doc_id % 2 = 1)
SELECT target, path, subpath, there AS exists FROM wanted""")
def open_hints(spark, sf_dir):
    own, n = docs(spark, sf_dir), F.col("doc_id")
    wanted = own.select(F.when(n % 2 == 0, F.concat("path", F.lit("#Part "), n.cast("string"))).otherwise(F.col("path")).alias("target"))
    return search.open_hints(wanted, own.where(n % 7 != 0))


# access


_POLICY = access.Policy(
    grants=(access.Rule("g1", directory="src1"), access.Rule("g2", directory="src2", role="editor"), access.Rule("g3", file="src3/doc-3.md")),
    denies=(access.Rule("d1", directory="SRC2/"), access.Rule("d2", file="src1/doc-1.md")),
)


# Paths whose components only a guarded comparison recognises, or that no policy allows.
_GUARDED = (
    ("ＳＲＣ2/x.md", "denied", "d1"), ("sr\u200bc2/x.md", "denied", "d1"), ("src\ufe0f2/x.md", "denied", "d1"), ("Src²/x.md", "denied", "d1"), ("s\u00adrc1/doc-1.md", "denied", "d2"),
    ("src1/\uff0ehidden/x.md", "reserved_path", None), ("src1/a:b.md", "invalid_path", None), ("src1/nul.md", "invalid_path", None), ("src1/x .md", "allowed", "g1"), ("src1/end./x.md", "invalid_path", None), ("ſrc1/x.md", "no_grant", None),
)


@query(f"""WITH {DOCS} SELECT path, CASE WHEN lower(path) LIKE 'src2/%' OR lower(path) = 'src1/doc-1.md' THEN 'denied' WHEN path LIKE 'src1/%' OR path = 'src3/doc-3.md' THEN 'allowed' ELSE 'no_grant' END AS reason,
CASE WHEN lower(path) LIKE 'src2/%' THEN 'd1' WHEN lower(path) = 'src1/doc-1.md' THEN 'd2' WHEN path LIKE 'src1/%' THEN 'g1' WHEN path = 'src3/doc-3.md' THEN 'g3' END AS rule FROM notes
UNION ALL VALUES """ + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _GUARDED))
def acl_decision(spark, sf_dir):
    d = access.decision(_POLICY)
    every = docs(spark, sf_dir).select("path").unionByName(spark.createDataFrame([(p,) for p, _, _ in _GUARDED], "path string"))
    return every.select("path", d["reason"].alias("reason"), d["rule"].alias("rule"))


@query(f"""WITH {DOCS} SELECT path, 'file' AS kind FROM notes WHERE (path LIKE 'src1/%' AND path <> 'src1/doc-1.md') OR path = 'src3/doc-3.md'
UNION ALL SELECT DISTINCT source, 'directory' FROM notes WHERE source IN ('src1', 'src3')""")
def acl_listing(spark, sf_dir):
    return access.visible_listing(docs(spark, sf_dir), _POLICY)


_VISIBLE = SYNTH.replace("synth AS (SELECT *,", "synth AS (SELECT * FROM (SELECT *,").replace("AS path FROM base)", "AS path FROM base) WHERE source IN ('src1', 'src3', 'src4', 'src5'))")


@query(f"WITH {_VISIBLE} SELECT source_path AS source, target, resolved FROM resolved")
def acl_graph(spark, sf_dir):
    policy = access.Policy(grants=tuple(access.Rule(s, directory=s) for s in ("src1", "src3", "src4", "src5")))
    seen = access.readable(synth(spark, sf_dir), policy)
    return graph.resolved(notes.indexed(notes.parse(seen))).select("source", "target", "resolved")


@query(f"WITH {SYNTH} SELECT path FROM synth WHERE quality = 1 AND source IN ('src1', 'src4')")
def audience_scope(spark, sf_dir):
    scope = access.Audience(("src1/", "src4/"), {"quality": 1})
    return parsed(spark, sf_dir).where(access.in_audience(scope)).select("path")


@query(f"""WITH {DOCS}, lines AS (SELECT path, sha256(path) AS key, sha256(lpad(CAST(length(path) AS VARCHAR), 8, '0') || path || sha256(content)) AS h FROM notes),
a AS (SELECT substr(key, 1, 8) AS key, sha256(string_agg(h, '' ORDER BY key, path)) AS h FROM lines GROUP BY substr(key, 1, 8)),
b AS (SELECT substr(key, 1, 5) AS key, sha256(string_agg(h, '' ORDER BY key)) AS h FROM a GROUP BY substr(key, 1, 5)),
c AS (SELECT substr(key, 1, 2) AS key, sha256(string_agg(h, '' ORDER BY key)) AS h FROM b GROUP BY substr(key, 1, 2))
SELECT sha256(string_agg(h, '' ORDER BY key)) AS fingerprint FROM c""")
def corpus_fingerprint(spark, sf_dir):
    return access.fingerprint(docs(spark, sf_dir).select("path", notes.source_revision(F.col("content")).alias("revision")))


# changes


def _changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("upsert")
    return e.select(F.concat(F.lit("user-"), F.col("user_id"), F.lit(".md")).alias("path"), kind.alias("kind"), F.col("event_id").alias("generation"))


_LATEST = "latest AS (SELECT 'user-' || user_id || '.md' AS path, max(event_id) AS generation, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'remove' ELSE 'upsert' END AS kind FROM events GROUP BY user_id)"


@query(f"WITH {_LATEST} SELECT path, generation, kind FROM latest")
def latest_generation(spark, sf_dir):
    return incremental.latest(_changes(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT path, kind, generation FROM latest WHERE generation % 3 <> 0 ORDER BY CASE kind WHEN 'remove' THEN 0 ELSE 1 END, generation, path LIMIT 32")
def due_batch(spark, sf_dir):
    work = incremental.latest(_changes(spark, sf_dir)).withColumn("not_before", F.when(F.col("generation") % 3 == 0, 100.0).otherwise(0.0))
    return incremental.due(work, 50.0, 32).select("path", "kind", "generation")


@query(f"""WITH {_LATEST}, w AS (SELECT CASE WHEN generation % 2 = 0 THEN 'done' ELSE kind END AS kind FROM latest), c AS (SELECT count(*) FILTER (kind = 'done') AS indexed, (SELECT count(*) FROM latest) AS total, count(*) FILTER (kind <> 'done') AS pending FROM w)
SELECT indexed, total, pending, CASE WHEN pending > 0 THEN 'warming' ELSE 'ready' END AS phase FROM c""")
def semantic_status(spark, sf_dir):
    work = incremental.latest(_changes(spark, sf_dir)).withColumn("kind", F.when(F.col("generation") % 2 == 0, "done").otherwise(F.col("kind")))
    return incremental.status(work, work.count())


def _two_listings(spark, sf_dir):
    d = docs(spark, sf_dir).select("path", "doc_id", F.octet_length("content").alias("size"), F.lit(0).alias("modified"), F.col("doc_id").alias("generation"))
    now = d.where(F.col("doc_id") % 7 != 0).withColumn("size", F.when(F.col("doc_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return d.where(F.col("doc_id") % 13 != 0), now


@query(f"WITH {DOCS} SELECT path FROM notes WHERE doc_id % 13 <> 0 AND doc_id % 7 = 0")
def reconcile_removed(spark, sf_dir):
    was, now = _two_listings(spark, sf_dir)
    return incremental.removed(was, now)


@query(f"""WITH {DOCS} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'remove' ELSE 'refresh' END AS kind FROM notes
WHERE NOT (doc_id % 13 = 0 AND doc_id % 7 = 0) AND (source IN ('src2', 'src5') OR doc_id % 17 = 0)""")
def event_changes(spark, sf_dir):
    """What events on two folders and on single files call for."""
    was, now = _two_listings(spark, sf_dir)
    files = docs(spark, sf_dir).where(F.col("doc_id") % 17 == 0).select("path")
    events = files.unionByName(spark.createDataFrame([("src2",), ("src5",), ("nowhere",)], "path string"))
    return incremental.event_changes(events, now, was)


@query(f"""WITH {DOCS} SELECT complete, path, kind FROM (
  SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'remove' ELSE 'refresh' END AS kind FROM notes
  WHERE (doc_id % 7 = 0 AND doc_id % 13 <> 0) OR (doc_id % 7 <> 0 AND (doc_id % 13 = 0 OR doc_id % 11 = 0))), (VALUES (true), (false)) t(complete) WHERE complete OR kind = 'refresh'""")
def reconcile_scan(spark, sf_dir):
    was, now = _two_listings(spark, sf_dir)
    out = [incremental.reconciled(was, now, c).select(F.lit(c).alias("complete"), "path", "kind") for c in (True, False)]
    return out[0].unionByName(out[1])


@query(f"""WITH {DOCS}, {_EDITED} SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'removed' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'same' END AS kind FROM notes""")
def policy_projection(spark, sf_dir):
    """Notes that a narrower policy and an edit take out of a view or change there."""
    hashed = lambda df: df.select("path", notes.source_revision(F.col("content")).alias("revision"))
    return incremental.projected(hashed(docs(spark, sf_dir)), hashed(_edited(spark, sf_dir).where(F.col("doc_id") % 4 != 0)))


@query(f"WITH {DOCS} SELECT path FROM notes WHERE doc_id % 7 <> 0 AND (doc_id % 13 = 0 OR doc_id % 11 = 0)")
def reconcile_changed(spark, sf_dir):
    return incremental.changed(*_two_listings(spark, sf_dir))


_HEAD = """'---' || chr(10) || 'tags: [' || lang || ', corpus/' || source || ']' || chr(10) || 'doc: ' || id || coalesce(chr(10) || 'quality: ' || quality, '') || chr(10) || '---' || chr(10)"""
_TOP = f"""'# Doc ' || id || repeat(chr(10), 2) || {_SYNTH_TEXT} || repeat(chr(10), 2)"""
_REST = """CASE WHEN id % 3 = 0 THEN '' ELSE '## Notes' || chr(10) || {0} || chr(10) || 'noted' || repeat(chr(10), 2) || CASE WHEN id % 3 = 2 THEN '### Detail' || repeat(chr(10), 2) || 'detailed' || repeat(chr(10), 2) ELSE '' END END
  || 'Filed #batch/b' || (id % 5) || chr(10) || CASE WHEN linked THEN 'See [[doc-' || ((id * 7 + 1) % 997) || ']]' || chr(10) ELSE '' END
  || CASE WHEN linked AND id % 4 = 0 THEN 'And [[missing-' || id || '|lost]]' || chr(10) ELSE '' END || CASE WHEN linked AND id % 6 = 0 THEN 'Or [[shared-' || (id % 20) || '#Doc]]' || chr(10) ELSE '' END"""


def _edited_notes(spark, sf_dir, edit: Callable[[str], str]) -> DataFrame:
    """(path, revision) of the composed notes after an edit."""
    text = synth(spark, sf_dir).select("path", F.udf(edit, "string", useArrow=True)("content").alias("c"))
    return text.select("path", notes.source_revision(F.col("c")).alias("revision"))


@query(f"""WITH {SYNTH} SELECT path, sha256({_HEAD} || 'inserted' || chr(10) || {_TOP} || {_REST.format("''")}) AS revision FROM synth""")
def prepend_after_fm(spark, sf_dir):
    return _edited_notes(spark, sf_dir, lambda c: frontmatter.prepend(c, "inserted"))


@query(f"""WITH {SYNTH} SELECT path, sha256({_HEAD} || {_TOP} || {_REST.format("''")} || 'last' || chr(10)) AS revision FROM synth""")
def append_to_note(spark, sf_dir):
    return _edited_notes(spark, sf_dir, lambda c: frontmatter.append(c, "last\n"))


@query(f"""WITH {SYNTH} SELECT path, sha256({_HEAD} || {_TOP} || {_REST.format("'patched' || chr(10)")}) AS revision FROM synth""")
def patch_heading(spark, sf_dir):
    def put(c):
        try:
            return markdown.patch(c, "prepend", "heading", "Notes", "patched")
        except KeyError:
            return c

    return _edited_notes(spark, sf_dir, put)


_SET = """'---' || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - corpus/' || source || chr(10) || 'doc: ' || id || coalesce(chr(10) || 'quality: ' || quality, '') || chr(10)"""


@query(f"""WITH {SYNTH} SELECT path, sha256({_SET} || 'seen: true' || chr(10) || '---' || chr(10) || {_TOP} || {_REST.format("''")}) AS revision FROM synth""")
def set_property(spark, sf_dir):
    return _edited_notes(spark, sf_dir, lambda c: frontmatter.set_field(c, "seen", True))


@query(f"""WITH {SYNTH} SELECT path, sha256(replace({_SET}, chr(10) || 'doc: ' || id, '') || '---' || chr(10) || {_TOP} || {_REST.format("''")}) AS revision FROM synth""")
def remove_property(spark, sf_dir):
    return _edited_notes(spark, sf_dir, lambda c: frontmatter.remove_field(c, "doc"))


# the library's other operations over composed cases


def _texts(spark, sf_dir, content) -> DataFrame:
    """(path, doc_id, content) with the content an expression over the documents' columns."""
    return docs(spark, sf_dir).withColumn("content", content).select("path", "doc_id", "content")


_KINDS_OF_FILE = """files AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '/.hidden/doc-' || doc_id || '.md' WHEN 1 THEN source || '/pic-' || doc_id || '.PNG'
  WHEN 2 THEN source || '/' || doc_id || '/.md' WHEN 3 THEN source || '/old/doc-' || doc_id || '.MD' ELSE source || '/doc-' || doc_id || '.md' END AS path FROM documents)"""


def _files(spark, sf_dir) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    at = lambda *parts: F.concat("source", *parts)
    kind = F.col("doc_id") % 5
    path = F.when(kind == 0, at(F.lit("/.hidden/doc-"), n, F.lit(".md"))).when(kind == 1, at(F.lit("/pic-"), n, F.lit(".PNG"))).when(kind == 2, at(F.lit("/"), n, F.lit("/.md"))).when(kind == 3, at(F.lit("/old/doc-"), n, F.lit(".MD"))).otherwise(at(F.lit("/doc-"), n, F.lit(".md")))
    return d.select(path.alias("path"))


@query(f"""WITH {_KINDS_OF_FILE} SELECT path, CASE doc_id % 5 WHEN 1 THEN 'attachment' WHEN 3 THEN 'excluded' ELSE 'note' END AS class FROM files WHERE doc_id % 5 IN (1, 3, 4)""")
def file_classes(spark, sf_dir):
    rules = paths.exclusion_rules(paths.ignore_lines("# old notes\n\n  **/old/  \n"))
    return _files(spark, sf_dir).where(folder.visible(F.col("path"))).select("path", folder.file_class(F.col("path"), rules).alias("class"))


@query(f"""WITH {_KINDS_OF_FILE}, c AS (SELECT CASE doc_id % 5 WHEN 1 THEN 'attachment' WHEN 3 THEN 'excluded' ELSE 'note' END AS class FROM files WHERE doc_id % 5 IN (1, 3, 4))
SELECT count(*) FILTER (class = 'note') AS notes, count(*) FILTER (class <> 'excluded') AS files, CAST(0 AS BIGINT) AS tags, CAST(0 AS BIGINT) AS links,
  CAST(coalesce(sum(CASE class WHEN 'note' THEN 3 WHEN 'attachment' THEN 10 END), 0) AS BIGINT) AS bytes, count(*) FILTER (class = 'excluded') AS excluded FROM c""")
def stats_of_all_files(spark, sf_dir):
    """Notes, attachments and excluded files counted together: the three kinds are apart."""
    found = file_classes(spark, sf_dir)
    parsed_ = notes.indexed(notes.parse(found.where("class = 'note'").select("path", F.lit("abc").alias("content"))))
    return notes.stats(parsed_, found.where("class <> 'note'").select("class", F.lit(10).cast("long").alias("size")))


@query(f"""WITH {_KINDS_OF_FILE} SELECT path FROM files WHERE path LIKE 'src4/%' AND path LIKE '%.md'""")
def list_files_only(spark, sf_dir):
    return search.listing(_files(spark, sf_dir), "src4", recursive=True, glob="**/*.md", with_directories=False).select("path")


_FRONT = """fronts AS (SELECT source || '/doc-' || doc_id || '.md' AS path, doc_id AS id, CASE doc_id % 6 WHEN 0 THEN '---' || chr(10) || 'a: [' || chr(10) || '---' || chr(10) || 'x'
  WHEN 1 THEN '---' || chr(13) || chr(10) || 'status: Half-Open ' || doc_id || chr(13) || chr(10) || 'nothing: null' || chr(13) || chr(10) || '---' || chr(13) || chr(10) || 'body'
  WHEN 2 THEN '---' || chr(10) || '---' || chr(10) || 'empty' WHEN 3 THEN ' ---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10)
  WHEN 4 THEN '---' || chr(10) || '- a' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'n: ' || doc_id || chr(10) || 'deep: {b: [1, two, null], a: true}' || chr(10) || '---' || chr(10) || 't' END AS content FROM documents)"""


def _fronts(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    t, k = n.cast("string"), n % 6
    text = F.when(k == 0, F.lit("---\na: [\n---\nx")).when(k == 1, F.concat(F.lit("---\r\nstatus: Half-Open "), t, F.lit("\r\nnothing: null\r\n---\r\nbody"))).when(k == 2, F.lit("---\n---\nempty")).when(k == 3, F.lit(" ---\na: 1\n---\n")).when(k == 4, F.lit("---\n- a\n---\n"))
    return _texts(spark, sf_dir, text.otherwise(F.concat(F.lit("---\nn: "), t, F.lit("\ndeep: {b: [1, two, null], a: true}\n---\nt"))))


@query(f"""WITH {_FRONT} SELECT path FROM fronts WHERE id % 6 IN (0, 4)""")
def rejected_notes(spark, sf_dir):
    return notes.rejected(notes.parse(_fronts(spark, sf_dir))).select("path")


@query(f"""WITH {_FRONT} SELECT path, CASE id % 6 WHEN 1 THEN '{{"nothing":null,"status":"Half-Open ' || id || '"}}' WHEN 2 THEN '{{}}' WHEN 5 THEN '{{"deep":{{"a":true,"b":[1,"two",null]}},"n":' || id || '}}' END AS frontmatter,
  CASE id % 6 WHEN 1 THEN 'status Half-Open ' || id || ' nothing' WHEN 5 THEN 'n ' || id || ' deep b 1 two a true' ELSE '' END AS text,
  CAST(CASE id % 6 WHEN 1 THEN 45 + strlen(CAST(id AS VARCHAR)) WHEN 2 THEN 8 WHEN 5 THEN strlen(content) - 1 ELSE 0 END AS BIGINT) AS body_start FROM fronts WHERE id % 6 NOT IN (0, 4)""")
def frontmatter_rows(spark, sf_dir):
    """The block as canonical JSON, its search text and where the body begins."""
    return notes.indexed(notes.parse(_fronts(spark, sf_dir))).select("path", "frontmatter", F.coalesce("property_text", F.lit("")).alias("text"), "body_start")


@query(f"""WITH {_FRONT} SELECT path, 'null' AS how FROM fronts WHERE id % 6 = 1 UNION ALL SELECT path, 'text' FROM fronts WHERE id % 6 = 1 UNION ALL SELECT path, 'object' FROM fronts WHERE id % 6 = 5""")
def property_cases(spark, sf_dir):
    """A property that is null exists; part of a text is contained; objects are equal whatever their keys' order."""
    own = notes.indexed(notes.parse(_fronts(spark, sf_dir)))
    tests = {"null": notes.property_exists("nothing") & notes.property_equals("nothing", None), "text": notes.property_contains("status", "f-Op"), "object": notes.property_equals("deep", {"a": True, "b": [1, "two", None]})}
    out = None
    for how, test in tests.items():
        rows = own.where(test).select("path", F.lit(how).alias("how"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT source || '/doc-' || doc_id || '.md' AS path, 'a' || doc_id || ',z/y' AS tags, 'in' || doc_id AS links FROM documents""")
def code_exclusion(spark, sf_dir):
    """Tags and links in fenced, indented and inline code don't count; those beside them do."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("#a"), n, F.lit(" [[in"), n, F.lit("]]\n\n```\n#b [[out]]\n```\n\n    #c [[out]]\n\n`#d` `[[out]]` #z/y\n"))
    own = notes.indexed(notes.parse(_texts(spark, sf_dir, text)))
    return own.select("path", F.array_join("inline_tags", ",").alias("tags"), F.array_join(F.transform("links", lambda x: x["target"]), ",").alias("links"))


@query("""SELECT source || '/doc-' || doc_id || '.md' AS path, 'heading,paragraph,code,list,quote,table,rule' AS kinds FROM documents""")
def block_kinds(spark, sf_dir):
    text = F.concat(F.lit("# H "), F.col("doc_id").cast("string"), F.lit("\n\nwords\nmore\n\n```\ncode\n```\n\n- one\n- two\n\n> said\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n"))
    return notes.indexed(notes.parse(_texts(spark, sf_dir, text))).select("path", F.array_join(F.transform("blocks", lambda x: x["kind"]), ",").alias("kinds"))


@query("""SELECT raw, lower(nfc_normalize(replace(regexp_replace(raw, '[.]md$', ''), chr(92), '/'))) AS key FROM (SELECT DISTINCT source || chr(92) || upper(lang) || '/É' || lang || 'e' || chr(769) || '.md' AS raw FROM documents)""")
def link_keys(spark, sf_dir):
    raw = F.concat("source", F.lit("\\"), F.upper("lang"), F.lit("/É"), "lang", F.lit("e\u0301.md"))
    return table(spark, sf_dir, "documents").select(raw.alias("raw")).distinct().select("raw", F.udf(paths.link_key, "string", useArrow=True)("raw").alias("key"))


@query(f"""WITH {DOCS} SELECT path, sha256(content) AS revision, CAST(greatest(1, strlen(content)) AS BIGINT) AS "end" FROM notes""")
def note_pages(spark, sf_dir):
    """Pages of 1000 bytes put together again: every byte once, cut at whole characters."""
    def joined(c):
        out, at = [], 0
        while True:
            found = search.page(c, at, None, 1000)
            out.append(found["content"])
            if found["next"] is None:
                return "".join(out), max(1, found["end"])
            at = found["next"]

    both = F.udf(joined, "struct<text:string,end:bigint>", useArrow=True)("content")
    return docs(spark, sf_dir).select("path", both.alias("p")).select("path", notes.source_revision(F.col("p.text")).alias("revision"), F.col("p.end").alias("end"))


@query(f"""WITH {DOCS}, spots AS (SELECT path, content, strpos(lower(content), 'licensed') AS p, length(content) AS n FROM notes)
SELECT path, sha256(substr(content, CAST(CASE WHEN p = 0 THEN 0 ELSE greatest(0, least(p - 1 - 150, n - 300)) END AS BIGINT) + 1, 300)) AS preview FROM spots WHERE length(lower(content)) = n""")
def previews(spark, sf_dir):
    shown = F.udf(lambda c: search.preview(c, "LICENSED"), "string", useArrow=True)
    return docs(spark, sf_dir).where(F.char_length(F.lower("content")) == F.char_length("content")).select("path", F.sha2(shown("content"), 256).alias("preview"))


@query(f"""WITH {DOCS}, {_DOC_TOKENS}, own AS (SELECT path, content, 'doc-' || doc_id || chr(10) || content AS whole FROM notes WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
sized AS (SELECT path, whole, list_sum(list_transform(regexp_split_to_array(trim(regexp_replace(whole, '[ \n\t\r]+', ' ', 'g')), ' '), lambda w: (strlen(w) + 7) // 8)) AS n FROM own)
SELECT path, sha256(whole) AS input_hash FROM sized WHERE n <= 200""")
def whole_chunks(spark, sf_dir):
    """Notes that are one chunk, with the hash of the text that is embedded."""
    return chunked(docs(spark, sf_dir)).where("scope = 'note'").select("path", "input_hash")


@query(f"""WITH {DOCS} SELECT path, sha256('---' || chr(10) || 'kind: note' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '---' || chr(10) || content) AS revision FROM notes""")
def create_with_properties(spark, sf_dir):
    put = F.udf(lambda c: frontmatter.with_frontmatter(c, {"kind": "note", "tags": ["a"]}), "string", useArrow=True)
    return docs(spark, sf_dir).select("path", notes.source_revision(put("content")).alias("revision"))


@query(f"""WITH {DOCS} SELECT path, row_number() OVER (ORDER BY path) AS generation FROM notes""")
def initial_generations(spark, sf_dir):
    return incremental.initial_generations(docs(spark, sf_dir))


@query(f"""WITH {DOCS} SELECT path, CASE WHEN doc_id % 10 = 0 OR doc_id % 25 = 0 THEN 1 ELSE 2 END AS modified FROM notes""")
def refreshed_stats(spark, sf_dir):
    """A note whose text is the same takes the present size and time; others keep theirs."""
    row = lambda df, t: df.select("path", notes.source_revision(F.col("content")).alias("revision"), F.octet_length("content").alias("size"), F.lit(t).alias("modified"))
    return incremental.refreshed(row(docs(spark, sf_dir), 1), row(_edited(spark, sf_dir).where(F.col("doc_id") % 25 != 0), 2)).select("path", "modified")


@query("""SELECT 'note-' || (vec_id % 100) || '.md' AS path, vec_id AS start, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id % 100 < 60""")
def vector_cache(spark, sf_dir):
    """Vectors saved, loaded, saved over themselves and taken up again for the notes that still exist."""
    at = f"{shared_dir(spark)}/vectors-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
    vectors.save(_chunks(spark, sf_dir), at, "space")
    vectors.save(vectors.load(spark, at, "space"), at, "space")
    live = _chunks(spark, sf_dir).select("path").distinct().where(F.regexp_extract("path", "[0-9]+", 0).cast("int") < 60)
    kept, _ = incremental.warm_start(vectors.load(spark, at, "space"), live, True)
    return kept.select("path", "start", F.size("vector").alias("dim"))


@query(f"""WITH {DOCS} SELECT path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(content || CASE WHEN doc_id % 3 = 0 THEN ' now' ELSE '' END) END AS revision FROM notes WHERE doc_id % 5 <> 0""")
def merged_changes(spark, sf_dir):
    """Upserts take their content, removals go, and changes older than the note count for nothing."""
    own, n = docs(spark, sf_dir), F.col("doc_id")
    base = own.select("path", "content", F.lit(10).cast("long").alias("generation"))
    later = own.where((n % 5 == 0) | (n % 3 == 0)).select("path", F.when(n % 5 == 0, "remove").otherwise("upsert").alias("kind"), F.lit(11).cast("long").alias("generation"))
    stale = own.where(n % 7 == 0).select("path", F.lit("remove").alias("kind"), F.lit(3).cast("long").alias("generation"))
    fresh = own.select("path", F.lit(11).cast("long").alias("generation"), F.concat("content", F.lit(" now")).alias("content"))
    return incremental.merge(base, later.unionByName(stale), fresh).select("path", notes.source_revision(F.col("content")).alias("revision"))


@query("""SELECT name, CASE WHEN name IN ('note_read', 'vault_list', 'search_text', 'vault_info') THEN 3 WHEN name IN ('note_create', 'note_write') THEN 2
  WHEN name IN ('note_read_many', 'search_regex', 'search_metadata', 'note_inspect') THEN 2 ELSE 1 END AS profiles
FROM (VALUES ('vault_list'), ('note_read'), ('note_read_many'), ('note_create'), ('note_write'), ('note_insert'), ('note_patch'), ('note_delete'), ('note_move'), ('search_text'), ('search_regex'), ('search_metadata'), ('search_semantic'), ('note_inspect'), ('frontmatter'), ('wikilinks'), ('vault_info')) v(name)""")
def tool_profiles(spark, sf_dir):
    """In how many of the three narrower profiles each operation is."""
    found = [(n, sum(n in config.offered(p) for p in ("core", "read", "minimal"))) for n in config.OPERATIONS]
    return spark.createDataFrame([x for x in found if x[1]], "name string, profiles int")


@query(f"""WITH {SYNTH}, ordered AS (SELECT path, 0 AS ordinal, 'Doc ' || id AS text, id, id % 3 AS k FROM synth UNION ALL SELECT path, 1, 'Notes', id, id % 3 FROM synth WHERE id % 3 <> 0 UNION ALL SELECT path, 2, 'Detail', id, 2 FROM synth WHERE id % 3 = 2)
SELECT path, ordinal, text, CASE WHEN ordinal = 0 THEN '# Doc ' || id || repeat(chr(10), 2) ELSE CASE ordinal WHEN 1 THEN '## Notes' || repeat(chr(10), 2) || 'noted' ELSE '### Detail' || repeat(chr(10), 2) || 'detailed' END END AS preview FROM ordered""")
def heading_pages(spark, sf_dir):
    """Heading rows with the start of what their previews show."""
    own = parsed(spark, sf_dir)
    rows = notes.heading_page(notes.heading_tree(own), own)
    start = F.when(F.col("ordinal") == 0, F.regexp_extract("preview", r"^(# Doc \d+\n\n)", 1)).when(F.col("ordinal") == 1, F.substring("preview", 1, 15)).otherwise(F.substring("preview", 1, 20))
    return rows.select("path", "ordinal", "text", start.alias("preview"))


@query(f"""WITH {DOCS}, ids AS (SELECT *, 'slack-w' || (doc_id % 3) || '-dm-a' || (doc_id % 2) AS scope FROM notes)
SELECT scope || '/' || doc_id AS name, doc_id % 4 IN (0, 1) AS eligible FROM ids""")
def private_sources(spark, sf_dir):
    d, n = docs(spark, sf_dir), F.col("doc_id")
    scope = F.concat(F.lit("slack-w"), n % 3, F.lit("-dm-a"), n % 2)
    path = F.concat(F.when(n % 4 == 2, F.lit("Notes/")).otherwise(F.lit("Organize/Work/")), scope, F.lit("/"), n, F.lit(".md"))
    text = F.concat(F.lit("---\ntenant_id: t\nstar_label: s\nworkspace_id: W"), n % 3, F.lit("\naudience_kind: dm\naudience_id: A"), n % 2, F.lit("\n---\n"), F.when(n % 4 == 3, F.lit("- [inferred x] y")).otherwise(F.lit("- plain")))
    test = F.udf(access.private_source_eligible, "boolean", useArrow=True)
    return d.select(F.concat(scope, F.lit("/"), n).alias("name"), test(path, text).alias("eligible"))
