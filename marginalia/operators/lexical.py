"""Boosted multi-field BM25, and its form without an index to keep (postings.py keeps one): a pass for the statistics, one for the scores.

Without an index each note carries its fields' tokens; a query's term counts are taken in place, so neither pass shuffles more
than one row of statistics for each partition. Ties go to the smaller path.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marginalia.functions.stemmer import stem

# What each field counts, and the ranking's constants.
BOOSTS = {"title": 5.0, "headings": 3.0, "frontmatter": 2.0, "body": 1.0}
FACET_BOOST = 4.0
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
MAX_TOKEN_BYTES = 40


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """English stems of token arrays; tokens of MAX_TOKEN_BYTES or more go."""
    return words.map(lambda ws: [stem(w) for w in ws if len(w.encode()) < MAX_TOKEN_BYTES])


def fields(parsed: DataFrame, stems: bool = False) -> DataFrame:
    """path with the tokens of title, headings, frontmatter and body, and the tag facets."""
    body = F.decode(F.substring(F.encode("content", "UTF-8"), F.col("body_start").cast("int") + 1, F.octet_length("content")), "UTF-8")
    text = {"title": F.col("title"), "headings": F.array_join(F.transform("headings", lambda h: h["text"]), " | "), "frontmatter": F.coalesce("property_text", F.lit("")), "body": body}
    cut = lambda t: stemmed(tokens(t)) if stems else tokens(t)
    return parsed.select("path", *[cut(t).alias(name) for name, t in text.items()], F.transform("tags", F.lower).alias("facets"))


def query_terms(query: str, stems: bool = False) -> list[str]:
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    return list(dict.fromkeys(map(stem, words))) if stems else words


def fuzzy(token: Column, word: str) -> Column:
    """One edit at most, a swap of neighbours counting as one."""
    close = F.levenshtein(token, F.lit(word), 1).between(0, 1)
    swaps = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    return F.char_length(token).between(len(word) - 1, len(word) + 1) & (close | token.isin(swaps))


def summed(parts: Column) -> Column:
    """The sum of an array of numbers, added by size: the same parts give the same bits in whatever order they came."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, x: a + x)


def scores(corpus: DataFrame, terms: list[str], boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(path, score) of the notes that have any of the terms in any of the fields."""
    if not terms or not boosts:
        return corpus.select("path", F.lit(0.0).alias("score")).limit(0)
    tf = lambda f, t: F.size(F.filter(f, lambda x: x == t)).cast("double")
    counted = corpus.select("path", *[F.size(f).alias(f"dl_{f}") for f in boosts], *[tf(f, t).alias(f"tf_{f}_{n}") for f in boosts for n, t in enumerate(terms)])
    known = counted.agg(
        F.count("*").alias("docs"),
        *[F.avg(f"dl_{f}").alias(f"avg_{f}") for f in boosts],
        *[F.count_if(F.col(f"tf_{f}_{n}") > 0).alias(f"df_{f}_{n}") for f in boosts for n in range(len(terms))],
    )

    def part(f: str, n: int) -> Column:
        t, df = F.col(f"tf_{f}_{n}"), F.col(f"df_{f}_{n}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        norm = t + K1 * (1 - B + B * F.col(f"dl_{f}") / F.col(f"avg_{f}"))
        return F.when(t > 0, boosts[f] * idf * t * (K1 + 1) / norm).otherwise(0.0)

    total = summed(F.array(*[part(f, n) for f in boosts for n in range(len(terms))]))
    return counted.join(F.broadcast(known)).select("path", total.alias("score")).where("score > 0")


def facet_scores(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """Notes with a tag that is one of the terms or lies below it, FACET_BOOST for each."""
    hit = lambda t: F.exists("facets", lambda x: (x == t) | F.startswith(x, F.lit(t + "/")))
    return corpus.select("path", sum((F.when(hit(t), FACET_BOOST).otherwise(0.0) for t in terms), F.lit(0.0)).alias("score")).where("score > 0")


def fuzzy_scores(corpus: DataFrame, terms: list[str], boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """Each field that has a token within one edit of a term counts its boost, once for each term."""
    hit = lambda f, t: F.exists(f, lambda x: fuzzy(x, t))
    total = sum((F.when(hit(f, t), boosts[f]).otherwise(0.0) for f in boosts for t in terms), F.lit(0.0))
    return corpus.select("path", total.alias("score")).where("score > 0")


def top(found: DataFrame, k: int, allowed: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The k best, paths breaking ties (if digits are given: ties of rounded scores); allowed paths are applied before ranking, statistics stay the corpus's."""
    if allowed is not None:
        found = found.join(allowed, "path", "left_semi")
    rank = F.col("score") if digits is None else F.round("score", digits)
    return found.orderBy(rank.desc(), "path").limit(k)


def normalized(hits: DataFrame) -> DataFrame:
    """Scores of a (bounded) hit list between 0 and 1; all 1 if they are equal; what isn't finite goes."""
    finite = hits.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    ends = finite.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return finite.join(F.broadcast(ends)).select("path", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


def term_statistics(corpus: DataFrame, field: str = "body") -> DataFrame:
    """(term, df): in how many notes each term occurs; partly counted before the shuffle."""
    return corpus.select(F.explode(F.array_distinct(field)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class QueryError(ValueError):
    """A query that can't be read."""


_PART = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)(?=[\s(]|$)|([+-])(?=\S)|(?:(\w+):)?(?:"([^"]*)"|([^\s()"]+)))')


def parse_query(text: str, names: tuple[str, ...] = tuple(BOOSTS)) -> dict:
    """A query with phrases, + and -, AND, OR, NOT, brackets and field: as a tree of must, should and must_not."""
    at, stack, sign = 0, [[]], ""
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"can't read the query at {text[at:]!r}")
        at = m.end()  # one token at a time
        opened, closed, word, mark, name, phrase, bare = m.groups()
        if opened:
            stack.append([("sign", sign)])
            sign = ""
        elif closed:
            if len(stack) == 1:
                raise QueryError("unmatched )")
            inner = stack.pop()
            stack[-1].append((inner[0][1], _clauses(inner[1:])))
        elif word == "NOT":
            sign = "-"
        elif word:
            stack[-1].append(("op", word))
        elif mark:
            sign = mark
        else:
            if name and name not in (*names, "tags"):
                raise QueryError(f"no field {name!r}")
            stack[-1].append((sign, {"field": name, "terms": query_terms(phrase if phrase is not None else bare), "phrase": phrase is not None}))
            sign = ""
    if len(stack) > 1 or sign:
        raise QueryError("the query ends too early")
    return _clauses(stack[0])


def _clauses(items: list) -> dict:
    out = {"must": [], "should": [], "must_not": []}
    for n, (sign, node) in enumerate(items):
        if sign == "op":
            continue
        beside = [items[k][1] for k in (n - 1, n + 1) if 0 <= k < len(items) and items[k][0] == "op"]
        if len(items) > 1 and items[-1][0] == "op" or items[0][0] == "op":
            raise QueryError("an operator without an operand")
        out["must_not" if sign == "-" else "must" if sign == "+" or "AND" in beside else "should"].append(node)
    return out


def _phrase(field: Column, terms: list[str]) -> Column:
    """Whether the terms stand side by side in a field's tokens."""
    words, n = F.array(*map(F.lit, terms)), len(terms)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(field) - n + 1)), lambda i: F.slice(field, i, n) == words)


def matching(tree: dict, boosts: dict[str, float] = BOOSTS) -> Column:
    """A query tree as a predicate over the token fields."""
    if "terms" in tree:
        names = ["facets" if tree["field"] == "tags" else tree["field"]] if tree["field"] else list(boosts)
        terms = tree["terms"]
        found = F.lit(False)
        for f in names:
            found |= _phrase(F.col(f), terms) if tree["phrase"] and len(terms) > 1 else F.arrays_overlap(f, F.array(*map(F.lit, terms)).cast("array<string>"))
        return found
    ok = F.lit(True)
    for x in tree["must"]:
        ok &= matching(x, boosts)
    for x in tree["must_not"]:
        ok &= ~matching(x, boosts)
    if tree["should"] and not tree["must"]:
        some = F.lit(False)
        for x in tree["should"]:
            some |= matching(x, boosts)
        ok &= some
    return ok


def tree_terms(tree: dict) -> list[str]:
    """The terms that count for the score: all but those that must not occur."""
    if "terms" in tree:
        return tree["terms"]
    return list(dict.fromkeys(t for x in (*tree["must"], *tree["should"]) for t in tree_terms(x)))


def all_terms(tree: dict) -> list[str]:
    """Every term of a query, also those that must not occur."""
    if "terms" in tree:
        return tree["terms"]
    return list(dict.fromkeys(t for x in (*tree["must"], *tree["should"], *tree["must_not"]) for t in all_terms(x)))


def with_stems(tree: dict) -> dict:
    """The query with each term's stem; tags stay as they are written."""
    if "terms" in tree:
        return tree if tree["field"] == "tags" else tree | {"terms": [stem(t) for t in tree["terms"]]}
    return {k: [with_stems(x) for x in v] for k, v in tree.items()}


def is_any(tree: dict) -> bool:
    """Whether every note with any of the terms matches."""
    return "terms" not in tree and not tree["must"] and not tree["must_not"] and all("terms" in x and not x["field"] and (not x["phrase"] or len(x["terms"]) < 2) for x in tree["should"])


def search(corpus: DataFrame, query: str, k: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """The k best notes for a query in the query grammar."""
    tree = parse_query(query)
    if k <= 0 or not tree_terms(tree):
        return corpus.select("path", F.lit(0.0).alias("score")).limit(0)
    hits = corpus.where(matching(tree)).select("path")
    return top(scores(corpus, tree_terms(tree)).join(hits, "path", "left_semi"), k, allowed)
