"""Tables of documents seen as notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_as_notes(documents: DataFrame) -> DataFrame:
    """(path, content, doc_id, lang, source): every document a note in its source's folder."""
    return documents.select(
        F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.coalesce("text", F.lit("")).alias("content"), "doc_id", "lang", "source",
    )


def composed_notes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Markdown composed from the tables' columns: front matter, headings, a tag, links, some broken or ambiguous.

    Every tenth note shares its stem with others; every fifth has no links; every fourth has a broken one.
    """
    n = F.col("doc_id")
    text = n.cast("string")
    shared = n % 10 == 9
    stem = F.when(shared, F.concat(F.lit("shared-"), (F.floor(n / 10) % 20).cast("string"))).otherwise(F.concat(F.lit("doc-"), text))
    path = F.concat(F.col("source"), F.lit("/"), F.when(shared, F.concat(text, F.lit("/"))).otherwise(""), stem, F.lit(".md"))
    linked = n % 5 != 3
    some = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    content = F.concat(
        F.lit("---\ntags: ["), F.col("lang"), F.lit(", corpus/"), F.col("source"), F.lit("]\ndoc: "), text,
        F.coalesce(F.concat(F.lit("\nquality: "), F.col("quality").cast("string")), F.lit("")), F.lit("\n---\n# Doc "), text,
        F.lit("\n\n"), F.regexp_replace("text", r"[^\p{L} ]", " "), F.lit("\n\n"),
        some(n % 3 == 1, F.lit("## Notes\n\nnoted\n\n")), some(n % 3 == 2, F.lit("## Notes\n\nnoted\n\n### Detail\n\ndetailed\n\n")),
        F.lit("Filed #batch/b"), (n % 5).cast("string"), F.lit("\n"),
        some(linked, F.lit("See [[doc-"), ((n * 7 + 1) % 997).cast("string"), F.lit("]]\n")),
        some(linked & (n % 4 == 0), F.lit("And [[missing-"), text, F.lit("|lost]]\n")),
        some(linked & (n % 6 == 0), F.lit("Or [[shared-"), (n % 20).cast("string"), F.lit("#Doc]]\n")),
    )
    return documents.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select(path.alias("path"), content.alias("content"), "doc_id", "lang", "source", "quality")
