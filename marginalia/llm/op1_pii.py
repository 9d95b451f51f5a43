r"""Personal data in texts, with DataFrame functions only on the main path.

Base spans come from four patterns with checks (octets, Luhn, digit counts). High-recall generators then
propose further, overlapping spans (spelled-out e-mails, bracketed addresses, cards and phones in other
layouts); each candidate gets features of its format and of its context (NEAR characters on either side,
whatever else stands there), an ensemble of boosted two-level trees, compiled to column expressions, scores
it, and its kind's calibrated threshold selects what may be added. Candidates that touch a base span are left
to it; of candidates that overlap, the one with the highest score stays, and what then overlaps none of
those that stay gets a second chance. The trees are fitted on the driver from EXAMPLES synthetic labelled
candidates whose features the same column expressions compute; half of them are held back, and the curve,
the thresholds and the precision by kind (`Trees.precision`) come from that half.

The patterns are written so that no text makes them slow: runs are taken possessively and a match
may only begin where a run begins (or where the last match ended), which is what leftmost matching finds.
Positions come from the lengths of what lies between matches, summed in two levels.

Defined cases: a null text counts as empty (no spans, the hash of an empty string); repeated rows get
the same result; offsets count code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import body

# The base patterns' kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({]at[\])}] ?| at )", r"(?: ?[\[({](?:dot|\.)[\])}] ?| dot |\.)"
#: kind, pattern: what may be personal data beside the base patterns.
GENERATORS = (
    ("email", rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}[a-z0-9-]{{1,63}}+(?:{_DOT}[a-z0-9-]{{2,63}}+){{1,4}}"),
    ("ip", r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({](?:dot|\.)[\])}] ?| dot )[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9./_-])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ ./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9A-Za-z-])"),
)
_QUICK = {"email": "@", "ip": None, "card": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
NEAR, EXAMPLES, PRECISION = 24, 2400, 0.98
_STEP = 256


def let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums(lengths: Column) -> Column:
    """Sums of all that stands before each element, in blocks so that long arrays cost little more than short ones."""
    prefix = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))

    def split(ls):
        inner = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / _STEP).cast("int")), lambda b: prefix(F.slice(ls, b * _STEP + 1, _STEP)))
        return let(inner, lambda parts: F.flatten(F.zip_with(F.transform(parts, lambda p: F.slice(p, 1, F.size(p) - 1)), F.slice(prefix(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), 1, F.size(parts)), lambda p, off: F.transform(p, lambda x: x + off))))

    return let(lengths, split)


def _empty() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")


def found(text: Column, pattern: str) -> Column:
    """start, end, match and the text just before and after of each leftmost, non-overlapping match."""

    def placed(pieces, matches):
        gaps = F.transform(matches, lambda m, i: (F.char_length(F.get(pieces, i)) + F.char_length(m)).cast("long"))
        return let(
            _sums(gaps),
            lambda sums: F.transform(
                matches,
                lambda m, i: let(
                    F.get(sums, i) + F.char_length(F.get(pieces, i)),
                    lambda s: F.struct(
                        s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match"),
                        F.right(F.concat(F.right(F.concat(F.coalesce(F.right(F.get(pieces, i - 1), F.lit(NEAR)), F.lit("")), F.coalesce(F.get(matches, i - 1), F.lit(""))), F.lit(NEAR)), F.get(pieces, i)), F.lit(NEAR)).alias("before"),
                        F.left(F.concat(F.get(pieces, i + 1), F.left(F.concat(F.coalesce(F.get(matches, i + 1), F.lit("")), F.coalesce(F.left(F.get(pieces, i + 2), F.lit(NEAR)), F.lit(""))), F.lit(NEAR))), F.lit(NEAR)).alias("after"),
                    ),
                ),
            ),
        )

    some = lambda ms: F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), lambda ps: placed(ps, ms))).otherwise(_empty())
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits has a Luhn check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    n = F.char_length(digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _span(x: Column, rank: int) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(rank).alias("kind"), x["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """All base spans: rank of the kind, start and end."""
    def of(rank: int, kind: str) -> Column:
        valid = F.filter(found(text, BASE[kind]), lambda x: _valid(kind, x["match"]))
        quick = F.contains(text, F.lit(_QUICK[kind])) if _QUICK[kind] else F.regexp_like(text, F.lit("[0-9]"))
        return F.when(quick, F.transform(valid, lambda x: _span(x, rank))).otherwise(F.array().cast(_SPANS))

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


FEATURES = ("generator", "n_digits", "n_chars", "marked", "luhn", "octets", "spread", "said", "other", "joined", "goes_on", "same_gap", "zeros", "tail")
# Words that speak for and against each kind in the text around a candidate.
_SAID = {
    "email": "mail|contact|write to|reach|@|address|adresse|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|ping|gateway|dns|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|pay|karte|carte|tarjeta|cc",
    "phone": r"tel|phone|call|fax|mobile|cell|whatsapp|ring|sms|anruf|appel|llam|handy|m[oó]vil",
}
_OTHER = r"order|version|isbn|serial|invoice|sku|ref|build|page|ticket|section|article|code|id\b|no\.|nr\.|\$|€|%"


def features(c: Column, kind: Column, generator: Column) -> list[Column]:
    """Numbers that describe a candidate's format and context, in the order of FEATURES."""
    m, near = c["match"], F.lower(F.concat(c["before"], F.lit(" "), c["after"]))
    num = digits(m)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    said = F.lit(False)
    for k, words in _SAID.items():
        said |= (kind == k) & F.regexp_like(near, F.lit(words))
    gaps = F.array_distinct(F.regexp_extract_all(m, F.lit("(?<=[0-9])[^0-9]+(?=[0-9])"), F.lit(0)))
    return [
        generator.cast("double"), F.char_length(num).cast("double"), F.char_length(m).cast("double"), yes(F.regexp_like(m, F.lit(r"(?i)[\[({](?:at|dot|\.)[\])}]"))),
        yes(F.when(F.char_length(num) > 0, luhn(num))), yes(F.regexp_like(F.regexp_replace(m, r"(?i) ?[\[({](?:dot|\.)[\])}] ?| dot ", "."), F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))),
        F.size(F.array_distinct(F.split(num, ""))).cast("double"), yes(said), yes(F.regexp_like(F.lower(c["before"]), F.lit(_OTHER))),
        yes(F.regexp_like(c["before"], F.lit(r"(?:[0-9A-Za-z/._+=-]|[0-9] )$"))), yes(F.regexp_like(c["after"], F.lit(r"^(?:[0-9A-Za-z/_=-]|[ .][0-9])"))), (F.size(gaps) == 1).cast("double"), yes(F.startswith(m, F.lit("00"))),
        yes(F.regexp_like(m, F.lit(r"(?i)(?:\.|dot\)?\]?\}? ?)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at)$"))),
    ]


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, str, str, str, int]]:
    """(generator, kind, match, before, after, label): synthetic candidates, half of them personal data."""
    rnd = random.Random(seed)
    pick, num = rnd.choice, lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["an", "er", "on", "ti", "th", "re", "es", "la", "mo"]) for _ in range(rnd.randint(1, 4)))
    around = lambda: (" ".join(word() for _ in range(4)) + " ")[-NEAR:]

    def card(valid: bool) -> str:
        x = [int(c) for c in pick("3456") + num(14)]
        total = sum(d if i % 2 else (2 * d - 9 * (2 * d > 9)) for i, d in enumerate(x))
        return "".join(map(str, x)) + str((-total + (0 if valid else rnd.randint(1, 9))) % 10)

    out = []
    while len(out) < n:
        g, y = rnd.randrange(4), rnd.randrange(2)
        kind, before, after = KINDS[g], around(), " " + around()
        hint = rnd.random() < 0.5
        if g == 0:
            at, dot = (pick([" (at) ", "[at]", " {at} ", "(at)"]), pick([" (dot) ", "[dot]", "(.)", "."])) if y and rnd.random() < 0.8 else (" at ", " dot " if y else ".")
            m = word() + pick(["", ".", "_"]) + word() + at + word() + dot + (pick(["com", "org", "net", "de", "fr"]) if y else pick([word(), "the", "and", "com", "net"]))
            before = (before + pick(["mail: ", "contact ", "write to "]))[-NEAR:] if y and hint else before
        elif g == 1:
            sep = pick(["[.]", "(.)", " dot ", "[dot]"])
            m = sep.join(str(rnd.randint(0, 255) if y else rnd.randint(256, 999)) for _ in range(4))
            before = (before + pick(["host ", "server ", "ip "]))[-NEAR:] if y and hint else (before + "version ")[-NEAR:] if not y and hint else before
        elif g == 2:
            x, sep = card(bool(y)), pick([".", "/", "_", "  ", " - "[:2]])
            m = sep.join(x[i : i + 4] for i in range(0, 16, 4))
            before = (before + pick(["card ", "visa "]))[-NEAR:] if y and hint else (before + pick(["order ", "serial "]))[-NEAR:] if hint else before
        elif y:
            sep = pick([" ", "-", "."])
            m = pick(["00" + pick("1349") + num(1) + sep, "", ""]) + pick([f"({num(3)}) ", num(3) + sep]) + num(3) + sep + num(4)
            before = (before + pick(["tel ", "call ", "phone: "]))[-NEAR:] if hint or m[0] not in "(0" else before
        else:
            m = pick([num(8), num(9), num(10), num(11), num(4) + "-" + num(4), num(4) + " " + num(4), num(3) + "." + num(3) + "." + num(3)])
            before = (before + pick(["order ", "ref ", "id ", "isbn ", "$"]))[-NEAR:] if hint else before
            after = pick([after, "/" + num(2), "%"])
            if rnd.random() < 0.3:  # part of a longer run of digit groups, such as a card number with a wrong check digit
                m, sep = " ".join(num(4) for _ in range(rnd.choice((2, 3)))), pick([" ", "-", "."])
                before, after = pick([(before, sep + num(4) + after), (before + num(4) + sep, after), (before + num(4) + sep, sep + num(4) + after)])
                before, after = before[-NEAR:], after[:NEAR]
        out.append((g, kind, m, before, after, y))
    return out


class Trees:
    """Boosted two-level trees over FEATURES with a calibrated threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3):
        fitted = np.arange(len(y)) % 2 == 0
        self.trees: list[tuple] = []
        self._grow(x[fitted], y[fitted], rounds, rate)
        s, t = self.raw(x[~fitted]), y[~fitted]
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * s + b)))
            a, b = a - 0.5 * (((p - t) * s).mean() + 0.001 * a), b - 0.5 * (p - t).mean()
        self.curve = (float(a), float(b))
        p = 1 / (1 + np.exp(-(a * s + b)))
        # the least threshold from which on the held-back candidates of a kind are right often enough
        self.thresholds, self.precision = [], []
        for g in range(len(GENERATORS)):
            own, true = p[x[~fitted][:, 0] == g], t[x[~fitted][:, 0] == g]
            right = [(float(c), float(true[own >= c].mean())) for c in np.linspace(0.3, 0.99, 70) if (own >= c).any()]
            cut, share = next(((c, share) for n, (c, share) in enumerate(right) if all(s >= PRECISION for _, s in right[n:])), (0.99, 0.0))
            self.thresholds.append(cut)
            self.precision.append(share)

    @staticmethod
    def _split(x, grad, hess):
        best = (0.0, 0, 0.0)
        total = grad.sum() ** 2 / (hess.sum() + 1)
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= c
                gain = grad[low].sum() ** 2 / (hess[low].sum() + 1) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1) - total
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(c))
        return best

    def _grow(self, x, y, rounds, rate):
        s = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-s))
            grad, hess = y - p, p * (1 - p)
            _, f, c = self._split(x, grad, hess)
            low = x[:, f] <= c
            node = [f, c]
            for side in (low, ~low):
                _, f2, c2 = self._split(x[side], grad[side], hess[side]) if side.any() else (0, 0, 0.0)
                leaf = []
                for part in (side & (x[:, f2] <= c2), side & (x[:, f2] > c2)):
                    v = float(rate * grad[part].sum() / (hess[part].sum() + 1))
                    leaf.append(v)
                    s[part] += v
                node.append((f2, c2, *leaf))
            self.trees.append(tuple(node))

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x))
        for f, c, *sides in self.trees:
            low = x[:, f] <= c
            for side, (f2, c2, a, b) in zip((low, ~low), sides):
                s += side * np.where(x[:, f2] <= c2, a, b)
        return s

    def column(self, values: Column) -> Column:
        """The calibrated score of an array of features, as an expression."""
        at = lambda f: F.get(values, F.lit(f))
        total = F.lit(0.0)
        for f, c, low, high in self.trees:
            leaf = lambda x: F.when(at(x[0]) <= x[1], x[2]).otherwise(x[3])
            total = total + F.when(at(f) <= c, leaf(low)).otherwise(leaf(high))
        a, b = self.curve
        return 1 / (1 + F.exp(-(a * total + b)))


def fit(spark: SparkSession) -> Trees:
    """The trees from the synthetic candidates; always the same."""
    rows = examples()
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, g int, kind string, match string, before string, after string, y int")
    got = df.select("n", "y", F.array(*features(F.struct("match", "before", "after"), F.col("kind"), F.col("g"))).alias("x")).collect()
    got.sort(key=lambda r: r["n"])
    return Trees(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=np.float64))


_CANDIDATES = "array<struct<start:bigint,end:bigint,kind:int,score:double>>"
#: Candidates that begin before or after one in order of their starts and may touch it: none is longer than some
#: 400 characters or shorter than seven, and those of one generator never overlap.
_REACH = 256


def _winners(candidates: Column) -> Column:
    """Of candidates in order of their starts those that no overlapping one beats (by score, length, then place)."""
    better = lambda d, c: (d["score"] > c["score"]) | ((d["score"] == c["score"]) & ((d["end"] - d["start"] > c["end"] - c["start"]) | ((d["end"] - d["start"] == c["end"] - c["start"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & (d["kind"] < c["kind"]))))))
    near = lambda i: F.slice(candidates, F.greatest(F.lit(1), i - _REACH), 2 * _REACH)
    return F.filter(candidates, lambda c, i: ~F.exists(near(i), lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & better(d, c)))


def _apart(candidates: Column, taken: Column) -> Column:
    return F.filter(candidates, lambda c: ~F.exists(taken, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))


def added_spans(text: Column, base: Column, model: Trees) -> Column:
    """Spans of candidates that touch no base span, reach their kind's threshold and win over what they overlap."""

    def of(g: int, kind: str, pattern: str) -> Column:
        score = lambda c: let(F.array(*features(c, F.lit(kind), F.lit(g))), model.column)
        rated = F.transform(_apart(found(text, pattern), base), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), score(c).alias("score")))
        quick = F.regexp_like(text, F.lit(r"(?i)[ \[({]at[\])} ]")) if kind == "email" else F.regexp_like(text, F.lit("[0-9]"))
        return F.when(quick, F.filter(rated, lambda c: c["score"] >= model.thresholds[g])).otherwise(F.array().cast(_CANDIDATES))

    def settled(every: Column) -> Column:
        first = lambda won: F.concat(won, _winners(_apart(every, won)))
        return F.transform(let(_winners(every), first), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))

    proposed = F.sort_array(F.concat(*[of(g, kind, pattern) for g, (kind, pattern) in enumerate(GENERATORS)]))
    return let(proposed, lambda every: F.when(F.size(every) > 0, settled(every)).otherwise(F.array().cast(_SPANS)))


def spans(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, text, base (array of start, kind's rank, end) and every (base and added ones), both in order."""
    base = docs.select("doc_id", body().alias("text")).withColumn("base", base_spans(F.col("text")))
    return base.withColumn("every", F.sort_array(F.array_distinct(F.concat("base", added_spans(F.col("text"), F.col("base"), model)))))


def joined(of: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(found_spans: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; of touching spans the first names the gap."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int"))
    done = F.aggregate(
        "every",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"]), F.get(names, s["kind"])).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.char_length("text"))),
    )
    return found_spans.select("doc_id", done.alias("text"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans(docs, fit(spark)).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))
