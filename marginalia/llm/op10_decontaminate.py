"""Benchmark passages in documents, found by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most k edits shares at least m - q + 1 - k q of its
q-grams with the place, all on neighbouring diagonals (place minus position in the passage). So every
q-gram of a text that some passage has is put on its diagonal; diagonals are gathered in overlapping
bands of 2 (k + 1), and the bands with enough shared q-grams are the only regions that a banded
alignment then checks. Nothing within the edit budget can be missed. k is `rate` of m, less where a
short passage would otherwise need no shared q-gram; passages shorter than q are looked for as they are.

Text is compared in lower case with runs of white space as one space. Passages are the stated query
set: they are taken in blocks of at most `block` characters, each broadcast as compressed text, and every
block meets every document in one scan; the driver holds one block at a time, a task the compressed blocks
and one block's table. Where q-grams are so common that their meetings pass EXPANSION, first the texts, then
the passages are halved; for one text and one passage the q-grams of a sliding window are counted instead,
which the same lemma bounds. So memory is bounded on any text, and nothing is left out.

Defined cases: null or blank passages match nothing; a null text counts as empty; equal passages are
all reported; repeated rows are reported each; empty tables give no rows; other columns are ignored by
`matches` and kept by `decontaminate`; ids may have any type that Arrow knows.
"""

from __future__ import annotations

import pickle
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from marginalia.llm.common import body, pieces

Q, RATE, BLOCK = 8, 0.1, 4_000_000
#: Meetings of q-grams that are held at once, and characters of documents that meet one block after the other.
EXPANSION, CHUNK = 1 << 19, 1 << 24
_GROUP = 1 << 19
#: Slots of a table's filter at most; smaller tables have eight or more for each q-gram.
_SLOTS = 1 << 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of Q = 8 characters, by doubling."""
    h = codes.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def aligned(passage: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of passage in region within k edits, or None.

    Rows of the edit table are filled for the whole passage, columns only over the region, which is itself a
    band of diagonals; insertions along a row are a running minimum.
    """
    n, m = len(region), len(passage)
    at = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for i in range(m):
        swap = cost[:-1] + (region != passage[i])
        down = cost + 1
        # costs and starts travel together: cost first, later start (the shorter occurrence) preferred
        key = down * (n + 2) + (n - start)
        key[1:] = np.minimum(key[1:], swap * (n + 2) + (n - start[:-1]))
        lead = key - at * (n + 2)
        key = np.minimum.accumulate(lead) + at * (n + 2)
        cost, start = key // (n + 2), n - key % (n + 2)
        if cost.min() > k:
            return None
    end = int(np.lexsort((at, cost))[0])
    return (int(cost[end]), int(start[end]), end) if cost[end] <= k else None


class Passages:
    """The q-gram table of a block of passages; find() gives their occurrences in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        kept = [(i, t) for i, t in ((i, normal(t or "")) for i, t in items) if t]
        self.short = [x for x in kept if len(x[1]) < Q]
        self.items = [x for x in kept if len(x[1]) >= Q]
        self.rate = rate

    def __getstate__(self):
        return {"short": self.short, "items": self.items, "rate": self.rate}

    @cached_property
    def table(self):
        """Sorted q-grams with the passage and position of each, a bit for each slot, and the passages' budgets."""
        codes = [codes_of(t) for _, t in self.items]
        m = np.array([len(c) for c in codes], dtype=np.int64)
        k = np.minimum((self.rate * m).astype(np.int64), (m - Q) // Q)
        need = m - Q + 1 - k * Q
        each = [grams(c) for c in codes]
        h = np.concatenate([*each, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(each)), [len(g) for g in each])
        pos = np.concatenate([*(np.arange(len(g)) for g in each), np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        slots = np.zeros(min(_SLOTS, 1 << max(10, (8 * len(h)).bit_length())), bool)
        slots[(h & np.uint64(len(slots) - 1)).astype(np.int64)] = True
        return codes, m, k, need, h[order], item[order], pos[order], slots

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits), offsets in the normalised text."""
        out, group, size = [], [], 0
        for n, t in enumerate(texts):
            t = normal(t)
            out += [(n, i, t.index(p), t.index(p) + len(p), 0) for i, p in self.short if p in t]
            group.append((n, t))
            size += len(t) + 1
            if size >= _GROUP:
                out += self._scan(group)
                group, size = [], 0
        return out + self._scan(group)

    def _scan(self, group) -> list[tuple[int, int, int, int, int]]:
        if not group or not self.items:
            return []
        codes, m, k, need, table, item, pos, slots = self.table
        # texts stand side by side; a separator that no text has keeps q-grams from crossing
        whole = codes_of("\x00".join(t for _, t in group))
        begins = np.cumsum([0, *(len(t) + 1 for _, t in group)])
        h = grams(whole)
        at = np.flatnonzero(slots[(h & np.uint64(len(slots) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(table, h[at], "left"), np.searchsorted(table, h[at], "right")
        real = hi > lo
        at, lo, many = at[real], lo[real], (hi - lo)[real]
        if not len(at):
            return []
        if many.sum() > EXPANSION:
            half = len(group) // 2
            if half:
                return self._scan(group[:half]) + self._scan(group[half:])
            return [x for part in self.halves for x in part._scan(group)] if len(self.items) > 1 else self._slide(group[0], h, at)
        where = np.repeat(at, many)
        entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(where))
        who = item[entry]
        diagonal = where - pos[entry] + int(m.max())
        wide = k[who] + 1
        n_bands = len(whole) + int(m.max()) + 2
        band = who * n_bands + diagonal // wide
        # a band and the one below it make one gathering place, so that bands overlap by half
        order = np.argsort(band, kind="stable")
        bands, first, counts = np.unique(band[order], return_index=True, return_counts=True)
        upto = first + counts
        joined = np.append(bands[1:] == bands[:-1] + 1, False)
        upto[joined] += counts[1:][joined[:-1]]
        own = bands // n_bands
        shared = pos[entry][order]
        # the lemma holds for positions of the passage, so one that is met again and again counts once
        enough = [n for n in np.flatnonzero(upto - first >= need[own]) if len(np.unique(shared[first[n] : upto[n]])) >= need[own[n]]]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for b, w in zip(bands[enough].tolist(), own[enough].tolist()):
            base = (b % n_bands) * int(k[w] + 1) - int(m.max())
            first, last = base - int(k[w]), base + 2 * int(k[w] + 1) + int(m[w]) + int(k[w])
            for doc in range(np.searchsorted(begins, max(0, first), "right") - 1, len(group)):
                left, right = int(begins[doc]), int(begins[doc + 1]) - 1
                if left > last:
                    break
                a, z = max(left, first), min(right, last)
                if z - a < m[w] - k[w]:
                    continue
                text, passage = group[doc][1], self.items[w][1]
                i = text.find(passage, a - left, z - left)
                hit = (0, i, i + len(passage)) if i >= 0 else None
                if hit is None and (got := aligned(codes[w], whole[a:z], int(k[w]))):
                    hit = (got[0], a - left + got[1], a - left + got[2])
                if hit and hit < found.get((doc, w), (1 << 30, 0, 0)):
                    found[doc, w] = hit
        return [(group[doc][0], self.items[w][0], s, e, edits) for (doc, w), (edits, s, e) in found.items()]


    @cached_property
    def halves(self) -> list[Passages]:
        half = len(self.items) // 2
        return [Passages(x, self.rate) for x in (self.items[:half], self.items[half:])]

    def _slide(self, entry: tuple[int, str], h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The best occurrence of the only passage in one text, in the windows that have enough of its q-grams."""
        (name, passage), (doc, text) = self.items[0], entry
        codes, m, k, need, *_ = self.table
        m, k, need = int(m[0]), int(k[0]), int(need[0])
        if (i := text.find(passage)) >= 0:
            return [(doc, name, i, i + len(passage), 0)]
        has = np.zeros(len(h) + 1, np.int64)
        has[at + 1] = 1
        upto = np.cumsum(has)
        ends = np.minimum(np.arange(len(h)) + m + k, len(h))
        starts = np.flatnonzero(upto[ends] - upto[:-1] >= need)
        best = (1 << 30, 0, 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > m + k) + 1) if len(starts) else []:
            a, z = int(run[0]), min(len(text), int(run[-1]) + m + k + Q)
            if got := aligned(codes[0], codes_of(text[a:z]), k):
                best = min(best, (got[0], a + got[1], a + got[2]))
        return [(doc, name, best[1], best[2], best[0])] if best[0] <= k else []


def blocks(items: DataFrame, block: int = BLOCK) -> list:
    """The passages in blocks of at most `block` characters (a longer passage is a block of its own), compressed and broadcast."""
    send, out = items.sparkSession.sparkContext.broadcast, []
    held, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if held and size + len(r["text"]) > block:
            out.append(send(zlib.compress(pickle.dumps(held))))
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    return out + [send(zlib.compress(pickle.dumps(held)))] if held else out


def _met(sent: list, rate: float):
    """Over batches with a column text: each batch with what the blocks' passages find in it."""

    def of(batches):
        last: dict[int, Passages] = {}

        def settle(held):
            found = [[] for _ in held]
            for n, part in enumerate(sent):
                if n not in last:
                    last.clear()
                    last[n] = Passages(pickle.loads(zlib.decompress(part.value)), rate)
                for b, out in zip(held, found):
                    out += last[n].find([x or "" for x in b.column("text").to_pylist()])
            return zip(held, found)

        held, size = [], 0
        for b in pieces(batches):
            held.append(b)
            size += b.column("text").nbytes
            if size >= CHUNK or len(sent) < 2:
                yield from settle(held)
                held, size = [], 0
        yield from settle(held)

    return of


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, start and end (in the normalised text) of each passage's best occurrence in each document."""
    kind = items.schema["item_id"].dataType
    met, item_type = _met(blocks(items, block), rate), to_arrow_type(kind)

    def of(batches):
        for b, got in met(batches):
            doc = b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
            cols = [pa.array([g[n] for g in got], t) for n, t in ((1, item_type), (4, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([doc, *cols], names=["doc_id", "item_id", "edits", "start", "end"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", body().alias("text")).mapInArrow(of, f"doc_id {ids}, item_id {kind.simpleString()}, edits int, start bigint, end bigint")


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """docs without those that hold a passage within its edit budget; rows and columns pass through unchanged."""
    met = _met(blocks(items, block), rate)

    def of(batches):
        for b, got in met(batches):
            hit = {g[0] for g in got}
            yield b.filter(pa.array([n not in hit for n in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(of, StructType(docs.schema.fields))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, items)
