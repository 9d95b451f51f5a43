"""Quality scores from a factorisation machine.

A document's inputs are its hashed words, the structure of its text (shares of symbols, digits,
repeats, line shapes) and its metadata that is part of the text itself (lengths), each put into
buckets. Pairwise interactions have rank RANK and are summed in linear time:
half of (sum of v x) squared minus the sum of (v x) squared, in each factor.

The machine is fitted on the driver from at most `bound` labelled documents (a documented bound); the
documents' features, not their texts, are gathered for it. Scoring reads whole texts row by row and
sends every executor parameters of fixed size.

Defined cases: a null text counts as empty and is scored; ids with several labels take the larger;
null labels are ignored; without labels, or with one kind only, every score is that kind's share
smoothed towards one half; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import body, in_fold, one_blas_thread, pieces, sampled_labels

WORDS, RANK, BOUND = 1 << 13, 8, 12_000
_STEPS = 12
_N_STATS = 18
WIDTH = WORDS + _N_STATS * _STEPS
_DIGITS, _UPPER = slice(48, 58), slice(65, 91)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_PUNCT = [ord(c) for c in ".,;:!?\"'()-"]


def statistics(raw: bytes, words: list[bytes], unique: set[bytes]) -> list[float]:
    """Numbers from 0 to 1 (shares, or logarithms of lengths) that describe a text's structure."""
    n, b = max(1, len(words)), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, int(b.sum()))
    chars = size - int(b[128:192].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    log = lambda x, top: min(1.0, np.log1p(x) / np.log1p(top))
    per_line = len(words) / n_lines
    symbols = int(b[_SYMBOLS].sum())
    return [
        log(len(words), 30_000), log(chars / n, 30), len(unique) / n, min(1.0, 20 * sum(map(eq, words, words[1:])) / n),
        min(1.0, 5 * symbols / chars), min(1.0, 20 * symbols / chars), min(1.0, 10 * int(b[_DIGITS].sum()) / chars), min(1.0, 5 * int(b[_UPPER].sum()) / chars),
        min(1.0, 5 * int(b[_PUNCT].sum()) / chars), 1 - len(set(lines)) / n_lines, log(len(lines), 1000), log(per_line, 1000),
        min(1.0, 20 * int(b[124]) / chars), sum(x.rstrip()[-1:] in b".!?" for x in lines) / n_lines, min(1.0, 50 * sum(len(w) > 20 for w in unique) / n),
        min(1.0, 5 * int(b[10]) / n), int(b[194:240].sum()) / chars, log(symbols, 1000),
    ]


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs."""
    words = raw.lower().split()
    unique = set(words)
    stats = np.minimum(np.array(statistics(raw, words, unique)) * _STEPS, _STEPS - 1).astype(np.int64) + WORDS + _STEPS * np.arange(_N_STATS)
    hashed = np.fromiter(map(crc32, unique), np.int64, len(unique)) & (WORDS - 1)
    at, many = np.unique(hashed, return_counts=True)
    x = np.sqrt(many)
    x = x / max(1.0, np.sqrt((x * x).sum()))
    return np.concatenate([at, stats]), np.concatenate([x, np.full(_N_STATS, 0.25)])


class Machine:
    """A factorisation machine for the logit of label 1."""

    def __init__(self, base: float):
        self.b, self.w, self.v = base, np.zeros(WIDTH), np.zeros((WIDTH, RANK))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        z = self.b + self.w[at] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Adagrad over shuffled batches; the same rows in the same order give the same machine."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Machine(float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return model
    rng = np.random.default_rng(seed)
    model.v = rng.normal(0, 0.05, model.v.shape)
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-2), np.full(model.v.shape, 1e-2), 1e-2
    # few steps of fewer rows where there are few rows, so that small samples also get a few hundred updates
    batch = max(8, min(batch, len(rows) // 20))
    for _ in range(epochs if len(rows) > 2000 else 3 * epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = [rows[k] for k in order[i : i + batch]]
            lens = np.array([len(r[0]) for r in some])
            at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            starts, row = np.cumsum(lens) - lens, np.repeat(np.arange(len(some)), lens)
            vx = model.v[at] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = model.b + np.add.reduceat(model.w[at] * x, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[i : i + batch]]) / len(some)
            g = slope[row] * x
            uniq, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, g, len(uniq)) + decay * model.w[uniq]
            raw = g[:, None] * (total[row] - vx)
            gv = np.stack([np.bincount(back, raw[:, f], len(uniq)) for f in range(RANK)], axis=1) + decay * model.v[uniq]
            gb = slope.sum()
            seen_w[uniq] += gw * gw
            seen_v[uniq] += gv * gv
            seen_b += gb * gb
            model.w[uniq] -= 4 * rate * gw / np.sqrt(seen_w[uniq])
            model.v[uniq] -= rate * gv / np.sqrt(seen_v[uniq])
            model.b -= rate * gb / np.sqrt(seen_b)
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND) -> Machine:
    """A machine from at most `bound` labelled ids of the training folds."""
    chosen = F.broadcast(sampled_labels(labels, label, bound))

    def of(batches):
        for b in pieces(batches):
            got = [features(x) for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([g[0].astype(np.int16).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())],
                names=["doc_id", "y", "at", "x"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", body().cast("binary").alias("raw")).join(chosen, "doc_id").select("doc_id", "y", "raw")
    found = joined.mapInArrow(of, f"doc_id {kind}, y int, at binary, x binary")
    # rows that share an id are one example, the same one in every run
    once = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("at", "x")).alias("f")).select("doc_id", "y", "f.at", "f.x")
    rows = sorted(((r["doc_id"], r["y"], bytes(r["at"]), bytes(r["x"])) for r in once.toLocalIterator()), key=lambda r: (r[0], r[2]))
    return fit_machine([(np.frombuffer(at, np.int16).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64), y) for _, y, at, x in rows])


def scored(docs: DataFrame, model: Machine, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; only texts are looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        one_blas_thread()
        for b in pieces(batches):
            s = np.array([model.score(*features(x)) for x in b.column("raw").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", in_fold(5, 0).alias("held_out"), body().cast("binary").alias("raw")).mapInArrow(of, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, fit(docs, labels), 0.3)
