"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed rules come first (too short, too repetitive). Then three shares of each remaining document
(symbols, repeated lines, words in repeated windows) are held against thresholds that its own language
and source set. A share counts as far as chance can't explain it: x - 3 sqrt(x) of n, where ten
neighbouring repeated words are one event; so one repeated line of a short text is nothing yet.

Every (language, source) keeps a mergeable quantile sketch of each share (counts of logarithmic
buckets, each 2 % wide, so sketches merge by adding counts and a quantile is off by 1 % of itself at
most; what is below RESOLUTION shares bucket zero). PRIOR documents of its language's sketch, which has
as many of the whole corpus's, are merged into it, so a small group leans on its parents and a large one
on itself, without a size at which one takes over. The fence is `upper + SPREAD * (upper - middle)` of
the merged sketch's quantiles; there is no fixed fence. The thresholds are joined back to the documents.

Defined cases: a null text has no words and fails the base rules; null languages and sources form
groups of their own; repeated rows count twice in the sketches and share a verdict; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, WORD, body, scratch, small, stash

RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
MIDDLE, UPPER, SPREAD, PRIOR = 0.5, 0.9, 3.0, 50.0
#: Standard errors that a count must exceed, and repeated words that count as one event.
ERRORS, RUN = 3.0, 10
#: Shares below this are in the sketch's first bucket.
RESOLUTION = 0.01
#: Distinct repeated windows up to which a window is looked up in their list; beyond it, windows are sorted.
_FEW = 12


def _let(value: Column, then) -> Column:
    """then(value) with value worked out once, also where `then` uses it inside a function of array elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""

    def windows(ws):
        n = F.size(ws)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(hashes, _covered))

    return _let(words, windows)


def _covered(hashes: Column) -> Column:
    twice = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i - 1))))

    def few(dup):
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(dup, h), i).otherwise(-1)), lambda i: i >= 0)

    def beside(pairs):
        is_same = lambda h, i: F.coalesce(F.get(pairs, i)["h"] == h, F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, i: is_same(x["h"], i - 1) | is_same(x["h"], i + 1)), lambda x: x["i"]))

    def covered(dup):
        many = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), beside)
        # each window adds the words that the one before it hasn't covered
        folded = F.aggregate(
            F.when(F.size(dup) <= _FEW, few(dup)).otherwise(many),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(dup) == 0, F.lit(0).cast("long")).otherwise(folded)

    return _let(twice, covered)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source with the counts that the rules use; texts are read once."""
    words = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), body().alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    return words.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def rated(counts: DataFrame) -> DataFrame:
    """counts with base_failed and the three shares, less what chance explains."""

    def share(x: str, n: str, event: int = 1) -> Column:
        beyond = F.greatest(F.lit(0.0), F.col(x) - ERRORS * F.sqrt((event * F.col(x)).cast("double")))
        return F.when(F.col(n) > 0, beyond / F.col(n)).otherwise(F.lit(0.0))

    return counts.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words", RUN).alias("repeat_ratio"),
    )


def bucket(x: Column) -> Column:
    """The sketch's bucket of a share: 2 % wide in logarithm, what is below RESOLUTION in bucket 0."""
    return F.when(x < RESOLUTION, 0).otherwise(F.floor(F.log(x / RESOLUTION) / F.log(F.lit(1.02))) + 1).cast("long")


def _value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.pow(F.lit(1.02), b - 0.5) * RESOLUTION)


def sketches(ratios: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one sketch of each share per language and source."""
    stacked = ratios.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r in RATIOS])).alias("x"))
    return stacked.groupBy("lang", "source", F.col("x.ratio").alias("ratio"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merged(own: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio, bucket, n): each group's counts and PRIOR times the parent's shares (its `by` is a prefix of the group's)."""
    shared = [c for c in by if c in parent.columns]
    up = parent.select(*[F.col(c).alias(f"_{c}") for c in shared], F.col("ratio").alias("_ratio"), F.col("bucket"), F.col("n"))
    total = W.partitionBy(*[f"_{c}" for c in shared], "_ratio")
    up = up.withColumn("n", PRIOR * F.col("n") / F.sum("n").over(total))
    on = F.col("ratio") == F.col("_ratio")
    for c in shared:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    lent = own.select(*by, "ratio").distinct().join(up, on).select(*by, "ratio", "bucket", "n")
    return own.select(*by, "ratio", "bucket", F.col("n").cast("double").alias("n")).unionByName(lent).groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio) with the fence that the sketch's quantiles give."""
    group = W.partitionBy(*by, "ratio")
    run = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: _value(F.min(F.when(F.col("upto") >= (q - 1e-9) * F.col("total"), F.col("bucket"))))
    found = run.groupBy(*by, "ratio").agg(at(MIDDLE).alias("mid"), at(UPPER).alias("up"))
    return found.select(*by, "ratio", (F.col("up") + SPREAD * (F.col("up") - F.col("mid"))).alias("fence"))


def thresholds(parts: DataFrame) -> DataFrame:
    """(_lang, _source) with the fence of each share."""
    whole = parts.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    langs = merged(parts.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n")), whole, ["lang"])
    own = fences(merged(parts, langs, ["lang", "source"]), ["lang", "source"])
    return own.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[F.max(F.when(F.col("ratio") == r, F.col("fence"))).alias(f"max_{r}") for r in RATIOS])


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept and the name of the first rule it breaks."""
    counts = stash(rated(measured(docs)), "counts")
    with scratch(docs.sparkSession) as keep:
        parts = stash(sketches(counts.where(~F.col("base_failed"))), "sketches")
        limits = small(keep(stash(thresholds(parts), "thresholds")))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *[F.when((F.col(r) >= RESOLUTION) & (F.col(r) > F.col(f"max_{r}")), F.lit(r)) for r in RATIOS])
    return joined.withColumn("broken", broken).withColumn("kept", F.col("broken").isNull())


def op9_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rid FROM documents),
wins AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM wins) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
counts AS (
  SELECT words.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered ON words.rid = covered.rid),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN greatest(0.0::DOUBLE, n_symbols - 3.0 * sqrt(n_symbols::DOUBLE)) / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN greatest(0.0::DOUBLE, n_dup_lines - 3.0 * sqrt(n_dup_lines::DOUBLE)) / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN greatest(0.0::DOUBLE, n_repeat_words - 3.0 * sqrt(10.0::DOUBLE * n_repeat_words)) / n_words ELSE 0 END AS repeat_ratio FROM counts),
stacked AS (
  SELECT lang, source, 'symbol_ratio' AS ratio, symbol_ratio AS v FROM rated WHERE NOT base_failed UNION ALL
  SELECT lang, source, 'dup_line_ratio', dup_line_ratio FROM rated WHERE NOT base_failed UNION ALL
  SELECT lang, source, 'repeat_ratio', repeat_ratio FROM rated WHERE NOT base_failed),
parts AS (
  SELECT lang, source, ratio, CASE WHEN v < 0.01 THEN 0 ELSE floor(ln(v / 0.01::DOUBLE) / ln(1.02::DOUBLE)) + 1 END AS bucket, count(*)::DOUBLE AS n FROM stacked GROUP BY ALL),
whole AS (SELECT ratio, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY ratio) AS s FROM parts GROUP BY ratio, bucket),
lang_counts AS (SELECT lang, ratio, bucket, sum(n) AS n FROM parts GROUP BY ALL),
lang_merged AS (
  SELECT lang, ratio, bucket, sum(n) AS n FROM (
    SELECT * FROM lang_counts UNION ALL SELECT g.lang, g.ratio, w.bucket, 50.0 * w.s FROM (SELECT DISTINCT lang, ratio FROM lang_counts) g JOIN whole w ON w.ratio = g.ratio) GROUP BY ALL),
lang_shares AS (SELECT lang, ratio, bucket, n / sum(n) OVER (PARTITION BY lang, ratio) AS s FROM lang_merged),
own AS (
  SELECT lang, source, ratio, bucket, sum(n) AS n FROM (
    SELECT lang, source, ratio, bucket, n FROM parts UNION ALL
    SELECT g.lang, g.source, g.ratio, l.bucket, 50.0 * l.s
    FROM (SELECT DISTINCT lang, source, ratio FROM parts) g JOIN lang_shares l ON l.ratio = g.ratio AND l.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total FROM own),
points AS (
  SELECT lang, source, ratio, min(bucket) FILTER (upto >= (0.5 - 1e-9) * total) AS b, min(bucket) FILTER (upto >= (0.9 - 1e-9) * total) AS c FROM run GROUP BY ALL),
levels AS (
  SELECT *, CASE WHEN b = 0 THEN 0 ELSE pow(1.02, b - 0.5) * 0.01 END AS mid, CASE WHEN c = 0 THEN 0 ELSE pow(1.02, c - 0.5) * 0.01 END AS up FROM points),
limits AS (
  SELECT lang, source, max(up + 3.0 * (up - mid)) FILTER (ratio = 'symbol_ratio') AS a, max(up + 3.0 * (up - mid)) FILTER (ratio = 'dup_line_ratio') AS b,
    max(up + 3.0 * (up - mid)) FILTER (ratio = 'repeat_ratio') AS c FROM levels GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (symbol_ratio < 0.01 OR coalesce(symbol_ratio <= a, true)) AND (dup_line_ratio < 0.01 OR coalesce(dup_line_ratio <= b, true))
    AND (repeat_ratio < 0.01 OR coalesce(repeat_ratio <= c, true)) AS kept
FROM rated LEFT JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang AND rated.source IS NOT DISTINCT FROM limits.source
"""
