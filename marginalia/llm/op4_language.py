"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a logistic classifier over hashed character n-grams
predicts it. A text goes to the codeword with the smallest loss, each bit weighted by how well its
classifier did on rows it wasn't fitted on, and is flagged ambiguous if the runner-up is close.

The classifiers are fitted on the driver from about `per_lang` documents of each learned language,
chosen by a hash, ROWS of all languages at most; of more than LANGS values of lang the most frequent are
learned. So a fit has a bounded size whatever the corpus and however many values lang has. Scoring reads whole texts, one row at
a time, and sends every executor one matrix of fixed size.

Defined cases: a null text or one without letters is `und` with score 0; with one learned language
every text with letters gets it; with none, every text is `und`; rows with null lang are scored, never
learned from; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import body, in_fold, one_blas_thread, pieces

BUCKETS = 1 << 12
PER_LANG = 400
#: Rows that the classifiers are fitted on at most (16 kB each), and languages that are learned at most.
ROWS, LANGS = 12_000, 1000
#: Languages with codewords from all two-way splits; more take random words.
EXHAUSTIVE = 6
MARGIN = 0.2
_PIECE = 1 << 18


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: every split in two for few classes, else random words chosen for their distance."""
    if n <= EXHAUSTIVE:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if row in s else -1 for s in splits] for row in range(n)], dtype=np.float64).reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    draws = (rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50))
    least = lambda m: ((m @ m.T) - 2 * bits * np.eye(n)).max()  # noqa: E731  the closest two words
    return min((m for m in draws if (abs(m.sum(axis=0)) < n).all()), key=least, default=rng.choice([-1.0, 1.0], (n, bits)))


def features(text: str) -> np.ndarray | None:
    """Square roots of n-gram shares (one to three characters, hashed) at length one; None without letters."""
    low = text.lower()
    counts, letters = np.zeros(BUCKETS), 0
    for i in range(0, len(low), _PIECE):
        codes = np.frombuffer(low[max(0, i - 2) : i + _PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)
        if not letters:
            letters = any(map(str.isalpha, low[i : i + _PIECE]))
        # what isn't a letter counts as one kind of gap
        codes = np.where((codes >= 0xC0) | ((codes >= 97) & (codes <= 122)), codes, np.uint32(32))
        two = codes[1:] * np.uint32(0x9E3779B1) + codes[:-1]
        three = two[1:] * np.uint32(0x85EBCA6B) + codes[:-2]
        for h in (codes * np.uint32(0xC2B2AE35), two, three):
            h = h * np.uint32(0x27D4EB2F)
            counts += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    if not letters:
        return None
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 20.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (buckets + 1, bits) of logistic classifiers for y in +1/-1, by gradient descent with momentum."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    v, y = np.zeros_like(w), y.astype(np.float32)
    slope_of = np.empty_like(w)
    for _ in range(steps):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w[:-1] + w[-1]), -30, 30)))
        np.matmul(x.T, slope, out=slope_of[:-1])
        slope_of[-1] = slope.sum(axis=0)
        v = 0.8 * v - np.float32(rate * 0.2) * (slope_of / np.float32(len(x)) + np.float32(decay) * w)
        w += v
    return w


class Decoder:
    """Codewords, bit classifiers and bit weights; `decode` gives language, score and ambiguity."""

    def __init__(self, langs: list[str], x: np.ndarray, labels: np.ndarray):
        self.langs = langs
        if len(langs) < 2:
            return
        self.words = codewords(len(langs))
        y = self.words[labels]
        held = np.arange(len(x)) % 4 == 3
        if held.sum() and len(set(labels[~held])) > 1:
            w = _fit(x[~held], y[~held])
            trial = x[held] @ w[:-1] + w[-1]
            right = ((trial * y[held]) > 0).mean(axis=0)
        else:
            right = np.ones(y.shape[1])
        odds = np.clip(right, 0.5, 0.999)
        self.bit_weights = np.log(odds / (1 - odds)) + 1e-3
        self.bit_weights /= self.bit_weights.sum()
        self.w = _fit(x, y)

    def decode(self, x: np.ndarray | None) -> tuple[str, float, bool]:
        if x is None or not self.langs:
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = x @ self.w[:-1] + self.w[-1]
        loss = (np.log1p(np.exp(np.clip(-self.words * margin, -30, 30))) * self.bit_weights).sum(axis=1)
        p = np.exp(2 * len(self.bit_weights) ** 0.5 * (loss.min() - loss))
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.langs[first], float(p[first]), bool(p[first] - p[second] < MARGIN)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Decoder:
    """A decoder from a hash sample of about `per_lang` training documents of each language, twice that at most."""
    train = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(4, 2))
    counts = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not counts:
        return Decoder([], np.empty((0, BUCKETS), np.float32), np.empty(0, int))
    per_lang = min(per_lang, max(1, ROWS // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in counts], "_lang string, _share double")
    chosen = train.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(draw < F.col("_share")).select("lang", "text")

    def of(batches):
        for b in batches:
            kept = [(lang, x) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([x.astype(np.float32).tobytes() for _, x in kept], pa.binary())], names=["lang", "x"])

    most = 2 * per_lang * len(counts)
    found = chosen.mapInArrow(of, "lang string, x binary").orderBy(F.xxhash64("x", "lang"), "x", "lang").limit(most)
    names, x = [], np.empty((0, BUCKETS), np.float32)
    for r in found.toLocalIterator():
        if len(names) == len(x):
            x = np.concatenate([x, np.empty((max(256, min(len(x), most - len(x))), BUCKETS), np.float32)])
        x[len(names)] = np.frombuffer(r["x"], np.float32)
        names.append(r["lang"])
    langs = sorted(set(names))
    number = {lang: n for n, lang in enumerate(langs)}
    return Decoder(langs, x[: len(names)], np.array([number[n] for n in names], dtype=int))


def identify(docs: DataFrame, model: Decoder) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document; only texts are looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        one_blas_thread()
        for b in pieces(batches):
            got = [model.decode(features(t) if t else None) for t in b.column("text").to_pylist()]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", in_fold(4, 2).alias("held_out"), body().alias("text")).mapInArrow(of, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
