"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

Fit: every word of at most `bound` labelled training documents (equal texts count once) is a dimension.
A word's weight in a text is (1 + log of its count) x its inverse document frequency x the square root of
its log-likelihood ratio with label 1, which is above zero for every word; no word is left out. (With inverse
document frequency alone, words that two texts share by chance outweigh the telling ones; README has figures.)
The examples' unit vectors go into an inverted index whose postings are cut into blocks of examples, each
with the largest weight of each word.

Search: the block maxima give each block's upper bound, the best blocks are scored first, and of the others
only those whose bound reaches the k-th similarity found are scored, so the neighbours are exact. A batch of
texts is searched at once; words of many examples are kept as rows of a dense table besides, which is the same
sum. Votes are weighted by the square of the similarity and put through a logistic curve fitted on
leave-one-out votes. The evidence is the doc_ids of the nearest examples.

Texts without any known word are at distance one from every example; their score is the share of label 1
among the examples that have no word either.

Defined cases: a null text counts as empty; ids labelled twice take the larger label, rows that share an id or
a text are one example with the larger label; null labels and ids are ignored; without labels, or with one
kind only, every score is that kind's smoothed share; equal similarities rank by the example's number; repeated
rows are scored alike; an empty table gives no rows; other columns are ignored by `scored` and kept by `without_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from marginalia.llm.common import body, in_fold, one_blas_thread, pieces, sampled_labels

BOUND, NEIGHBOURS, BLOCK, EVIDENCE = 6000, 15, 64, 3
#: Examples that the curve is fitted on at most; texts and words of texts that are searched at once (a longer text is searched alone).
CURVE, _QUERIES, _WORDS = 4000, 64, 1 << 14
#: A word in more than one of so many examples is kept as a dense row.
_DENSE = 16
_terms = re.compile(r"[^\W\d_]+").findall


def terms(text: str) -> Counter:
    """How often each word of a text occurs, in lower case."""
    return Counter(_terms(text.lower()))


def surprise(n: np.ndarray, k: np.ndarray, total: int, ones: int) -> np.ndarray:
    """Twice the log-likelihood ratio for words in n of `total` documents, k of them among the `ones` with label 1."""
    out = np.zeros(len(n))
    for seen, side, row in ((k, ones, n), (n - k, total - ones, n), (ones - k, ones, total - n), (total - ones - n + k, total - ones, total - n)):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] * total / (side * row[some]))
    return np.maximum(out, 0)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), then the same for the others."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


class Index:
    """Block-max inverted index over the examples' vectors, with the vote's calibration.

    idf holds each word's weight; rows are (counts, label) or (counts, label, doc_id).
    """

    def __init__(self, idf: dict[str, float], rows: list[tuple], prior: float, k: int = NEIGHBOURS):
        self._name(list(idf), np.array(list(idf.values()), dtype=np.float64), prior, k)
        self._fill([(self.vector(row[0]), row[1], row[2] if len(row) > 2 else n) for n, row in enumerate(rows)])

    @classmethod
    def of(cls, words: list[str], weights: np.ndarray, rows: list[tuple], prior: float, k: int = NEIGHBOURS) -> Index:
        """The same from words with their weights, and rows of (numbers of words, counts, label, doc_id)."""
        index = cls.__new__(cls)
        place = index._name(words, weights, prior, k)
        index._fill([(index._unit(np.sort(d), n[np.argsort(d)]), y, doc) for d, n, y, doc in ((place[at], n, y, doc) for at, n, y, doc in rows)])
        return index

    def _name(self, words, weights, prior, k) -> np.ndarray:
        """Keep the words as their hashes in order (few bytes each, whatever their length); where each word went."""
        keys = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        order = np.argsort(keys)
        self.keys, self.idf = keys[order], np.asarray(weights, dtype=np.float64)[order]
        self.k, self.prior, self.curve, self._rows = k, prior, (0.0, 0.0), None
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return place

    def _fill(self, examples) -> None:
        blank = [y for v, y, _ in examples if v is None]
        self.blank = (sum(blank) + 2 * self.prior) / (len(blank) + 2)
        held = self._in_order([e for e in examples if e[0] is not None])
        self.y = np.array([y for _, y, _ in held], dtype=np.float64)
        self.names = [name for _, _, name in held]
        self._post([v for v, _, _ in held])
        self._calibrate([v for v, _, _ in held])

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _in_order(self, held):
        """Examples with the same commonest word and the same heaviest word lie in the same blocks, which keeps bounds low."""
        spread = np.zeros(len(self.keys), np.int64)
        for v, _, _ in held:
            spread[v[0]] += 1
        return sorted(held, key=lambda e: (int(e[0][0][np.argmax(spread[e[0][0]])]), int(e[0][0][np.argmax(e[0][1])]), len(e[0][0])))

    def _post(self, vectors) -> None:
        size, self.blocks = len(self.keys), -(-len(vectors) // BLOCK)
        dim = np.concatenate([np.empty(0, np.int32), *(d.astype(np.int32) for d, _ in vectors)])
        who = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(d) for d, _ in vectors])
        order = np.argsort(dim, kind="stable")
        dim, self.who = dim[order], who[order]
        self.weight = np.concatenate([np.empty(0, np.float32), *(w.astype(np.float32) for _, w in vectors)])[order]
        self.start = np.searchsorted(dim, np.arange(size + 1)).astype(np.int32)
        # block postings: (word, block) with the first posting and the largest weight; the next one's first ends it
        block = self.who // BLOCK
        first = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (block[1:] != block[:-1]))) if len(dim) else np.empty(0, np.int64)
        self.first = np.append(first, len(dim)).astype(np.int32)
        self.block = block[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(dim) else np.empty(0, np.float32)
        self.block_start = np.searchsorted(dim[first], np.arange(size + 1)).astype(np.int32)
        wide = np.flatnonzero(np.diff(self.start) * _DENSE > max(1, len(vectors)))
        self.row = np.full(size, -1, np.int32)
        self.row[wide] = np.arange(len(wide))
        self.wide = wide

    def _dense(self):
        """The postings and block maxima of the words of many examples as dense rows."""
        if self._rows is None:
            rows, most = np.zeros((len(self.wide), self.blocks * BLOCK)), np.zeros((len(self.wide), self.blocks))
            for r, d in enumerate(self.wide):
                own, blocks = slice(self.start[d], self.start[d + 1]), slice(self.block_start[d], self.block_start[d + 1])
                rows[r, self.who[own]] = self.weight[own]
                most[r, self.block[blocks]] = self.most[blocks]
            self._rows = rows, most
        return self._rows

    @property
    def ids(self) -> list[np.ndarray]:
        """The examples of each dimension."""
        return np.split(self.who, self.start[1:-1]) if len(self.keys) else []

    @property
    def weights(self) -> list[np.ndarray]:
        return np.split(self.weight, self.start[1:-1]) if len(self.keys) else []

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Dimensions and weights, at length one, of what a text has of the vocabulary."""
        if not counts or not len(self.keys):
            return None
        keys = np.fromiter(map(xxh64_intdigest, counts), np.uint64, len(counts))
        order = np.argsort(keys)
        d = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        known = self.keys[d] == keys[order]
        return self._unit(d[known], np.fromiter(counts.values(), np.int64, len(counts))[order][known])

    def _unit(self, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        w = (1 + np.log(n)) * self.idf[d]
        return (d, w / np.linalg.norm(w)) if len(d) else None

    def search(self, vectors, k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector its k most similar examples (but[i] left out) and their similarities, exactly."""
        one_blas_thread()
        q, width = len(vectors), self.blocks * BLOCK
        dense, dense_most = self._dense()
        dim, weight = (np.concatenate([v[side] for v in vectors]) for side in (0, 1))
        who = np.repeat(np.arange(q), [len(v[0]) for v in vectors])
        row = self.row[dim]
        wide = row >= 0
        heavy = np.zeros((q, len(dense)))
        heavy[who[wide], row[wide]] = weight[wide]
        dim, weight, who = dim[~wide], weight[~wide], who[~wide]
        many = self.block_start[dim + 1] - self.block_start[dim]
        entry, who, weight = _ranges(self.block_start[dim], many), np.repeat(who, many), np.repeat(weight, many)
        at = who * self.blocks + self.block[entry]
        bound = np.bincount(at, weight * self.most[entry], q * self.blocks).reshape(q, self.blocks) + heavy @ dense_most

        def score(wanted):
            use = wanted.ravel()[at]
            first, many = self.first[entry[use]], self.first[entry[use] + 1] - self.first[entry[use]]
            post = _ranges(first, many)
            s = np.bincount(np.repeat(who[use], many) * width + self.who[post], np.repeat(weight[use], many) * self.weight[post], q * width).reshape(q, width).astype(np.float64, copy=False)
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows, cols = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                s[rows, cols] += heavy[rows] @ dense[:, cols]
            if but is not None:
                s[np.arange(q)[but >= 0], but[but >= 0]] = 0
            return s

        best = min(self.blocks, max(2, -(-2 * k // BLOCK)))
        wanted = np.zeros((q, self.blocks), bool)
        np.put_along_axis(wanted, np.argpartition(-bound, best - 1, axis=1)[:, :best], True, axis=1)
        s = score(wanted)
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if width >= k else np.zeros(q)
        rest = ~wanted & (bound >= least[:, None] - 1e-9) & (bound > 0)
        if rest.any():
            s += score(rest)
        top = np.argpartition(-s, min(width, 2 * k) - 1, axis=1)[:, : 2 * k]
        out = []
        for i in range(q):
            # ties at the cut are settled by the example's number, over all that tie
            at_least = np.sort(s[i, top[i]])[::-1][min(k, top.shape[1]) - 1]
            e = np.flatnonzero(s[i] >= max(at_least - 1e-12, 1e-300))
            e = e[np.lexsort((e, -np.round(s[i, e], 12)))][:k]
            out.append((e, s[i, e]))
        return out

    def nearest(self, v: tuple[np.ndarray, np.ndarray], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.search([v], k, np.array([but]))[0]

    def _vote(self, e: np.ndarray, s: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by the square of the similarity, with the prior as one weak vote."""
        w = s * s / max(1e-9, float((s * s).sum()))
        return (float((w * self.y[e]).sum()) + 0.01 * self.prior) / (float(w.sum()) + 0.01)

    def _calibrate(self, vectors) -> None:
        """Logistic curve over the log odds of leave-one-out votes of at most CURVE examples."""
        some = np.arange(0, len(vectors), max(1, -(-len(vectors) // CURVE)))
        x = np.empty(len(some))
        for i in range(0, len(some), _QUERIES // 4):
            part = some[i : i + _QUERIES // 4]
            x[i : i + len(part)] = [self._odds(self._vote(e, s)) for e, s in self.search([vectors[n] for n in part], self.k, part)]
        y = self.y[some]
        if len(set(y)) < 2:
            self.curve = (1.0, 0.0)
            return
        a, b = 1.0, 0.0
        for _ in range(100):  # Newton steps, none longer than one, with a pull towards the identity
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + 0.1 * b])
            q = p * (1 - p)
            h = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            step /= max(1.0, float(np.linalg.norm(step)))
            a, b = a - step[0], b - step[1]
        self.curve = (float(a), float(b))

    @staticmethod
    def _odds(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return float(np.log(p / (1 - p)))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list]]:
        """Calibrated scores and the doc_ids of the nearest examples (the evidence) of a batch of texts."""
        out, evidence = np.full(len(texts), self.blank), [[] for _ in texts]
        a, b = self.curve
        part, size = [], 0

        def settle():
            for (n, _), (e, s) in zip(part, self.search([v for _, v in part], self.k) if part else []):
                out[n] = 1 / (1 + np.exp(-np.clip(a * self._odds(self._vote(e, s)) + b, -50, 50)))
                evidence[n] = [self.names[x] for x in e[:EVIDENCE]]

        for n, text in enumerate(texts):
            if (v := self.vector(terms(text))) is None:
                continue
            if part and (len(part) == _QUERIES or size + len(v[0]) > _WORDS):
                settle()
                part, size = [], 0
            part.append((n, v))
            size += len(v[0])
        settle()
        return out, evidence

    def score(self, text: str) -> tuple[float, list]:
        s, e = self.scores([text])
        return float(s[0]), e[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND) -> Index:
    """An index over at most `bound` labelled ids of the training folds; their words are counted on the executors."""
    chosen = F.broadcast(sampled_labels(labels, label, bound))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", body().alias("text")).join(chosen, "doc_id").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.first("text").alias("text"))

    def counted(batches):
        for b in pieces(batches):
            got = [terms(x) for x in b.column("text").to_pylist()]
            cols = [pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *cols], names=["doc_id", "y", "ts", "ns"])

    number: dict[str, int] = {}
    rows, seen = [], set()
    found = sample.select("doc_id", "y", "text").mapInArrow(counted, f"doc_id {kind}, y int, ts array<string>, ns array<int>")
    for r in found.toLocalIterator():
        rows.append((r["doc_id"], r["y"], np.array([number.setdefault(t, len(number)) for t in r["ts"]], np.int64), r["ns"]))
    rows.sort(key=lambda r: (r[0], -r[1], len(r[2])))
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    total, ones = len(rows), sum(y for _, y, _, _ in rows)
    prior = (ones + 1) / (total + 2)
    if not 0 < ones < total:
        return Index({}, [], prior)
    n, k = (np.bincount(np.concatenate([np.empty(0, np.int64), *(ts for _, y, ts, _ in rows if y or every)]), minlength=len(number)) for every in (True, False))
    weight = (np.log((1 + total) / (1 + n)) + 1) * np.sqrt(surprise(n, k, total, ones) / total + 1e-6)
    return Index.of(list(number), weight, [(ts, np.array(ns), y, doc) for doc, y, ts, ns in rows], prior)


def scored(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest examples); only texts are looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        for b in pieces(batches):
            s, evidence = index.scores(b.column("text").to_pylist())
            cols = [pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(b.column("doc_id").type))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select("doc_id", in_fold(5, 0).alias("held_out"), body().alias("text")).mapInArrow(of, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")


def without_toxic(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """docs without the rows scored at `threshold` or more; rows and columns pass through unchanged."""

    def of(batches):
        for b in pieces(batches):
            s, _ = index.scores([x or "" for x in b.column("text").to_pylist()])
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(of, StructType(docs.schema.fields))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, fit(docs, labels))
