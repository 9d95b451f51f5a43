"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within `radius` bits agree on some segment up
to a few bits (pigeonhole), so every fingerprint looks up the small Hamming ball of each of its
segments in that segment's table; what it meets is verified over all bits. Candidates are compared
as numpy blocks in sorted partitions and only a spanning forest of the verified links leaves a task,
so a dense group of n variants costs at most n rows each time, never n squared.

deduplicate() links texts whose sets of five-word shingles have Jaccard similarity 0.8 or more. It takes wider
fingerprints over the sets, 576 bits in 24 segments of 24, each looked up in its ball of one bit, and verifies
complete distances; as no number of bits decides at 0.8, what the search connects (a family) is then counted
over the sets themselves. A pair at exactly 0.8 differs in 15 % of the bits and meets in some segment with
probability 0.92 (0.95 at 0.82, 0.99 at 0.85); members of a family meet whether or not they met in a segment.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; repeated rows share a fingerprint and so a component; a null doc_id never becomes a
component's name unless the component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from xxhash import xxh64_intdigest

from marginalia.llm.common import body, give_back, join_hot, pieces, scratch, small, stash, unused

BITS, SEED = 64, 42
#: Table rows of one segment value that one task holds; more are dealt out over salts.
TABLE_ROWS = 1 << 18
_CHUNK = 1 << 16
_PAIRS = 1 << 18


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words of a UTF-8 text, A-Z lower-cased, repeats included."""
    words = raw.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter(
        (xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])),
        dtype=np.uint64,
        count=len(words) - width + 1,
    )


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits drawn from hashes, by multiplying and shifting."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray, longs: int = 1) -> np.ndarray:
    """Majority of each bit over the hashes, then over mixes of them, as `longs` unsigned numbers."""
    votes = np.zeros((longs, BITS), dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        part = h[i : i + _CHUNK].astype("<u8")
        for n in range(longs):
            part = _mixed(part) if n else part
            votes[n] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(h), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint of every row as a signed long (fp); other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        for b in pieces(batches):
            fps = np.array([majority(shingle_hashes(x, width))[0] for x in b.column("raw").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", body().cast("binary").alias("raw")).mapInArrow(of, f"doc_id {kind}, fp bigint")


def plan_segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment to search.

    The radii are the smallest for which no link within `radius` can be missed: of m segments the
    first (radius mod m) + 1 take radius div m, the others one less.
    """
    base, extra = divmod(BITS, segments)
    r, a = divmod(radius, segments)
    out, shift = [], 0
    for k in range(segments):
        width = base + (k < extra)
        own = r if k <= a else r - 1
        if own >= 0:
            out.append((shift, width, own))
        shift += width
    return out


def _masks(width: int, ball: int) -> list[int]:
    return [sum(1 << i for i in bits) for n in range(ball + 1) for bits in combinations(range(width), n)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _search(radius: int):
    """Over batches sorted by (key, part): part is 2 * salt for a table's row, one more for a probe of it."""

    def found(batches):
        left = [np.empty(0, np.int64) for _ in range(3)]
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp")]
            key, part, fp = (np.concatenate(p) for p in zip(left, own))
            if not len(key):
                continue
            probe = (part & 1).astype(bool)
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] >> 1 != part[:-1] >> 1)])
            group = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            tables = np.bincount(group[~probe], minlength=len(starts))
            who = np.flatnonzero(probe & (tables[group] > 0))
            many = tables[group[who]]
            upto = np.cumsum(many)
            i = 0
            while i < len(who):
                done = upto[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(upto, done + _PAIRS)))
                n = many[i:j]
                p = np.repeat(who[i:j], n)
                t = np.repeat(starts[group[who[i:j]]] - np.cumsum(n) + n, n) + np.arange(len(p))
                # counted as unsigned numbers: of a negative one, numpy counts the bits of its absolute value
                near = (fp[p] < fp[t]) & (np.bitwise_count((fp[p] ^ fp[t]).view(np.uint64)) <= radius)
                if near.any():
                    a, b = _forest(fp[p[near]], fp[t[near]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                i = j
            keep = slice(starts[-1], starts[-1] + tables[-1])
            left = [x[keep] for x in (key, part, fp)]

    return found


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what links up to `radius` bits connect."""
    keys = []
    for k, (shift, width, own) in enumerate(plan_segments(radius, segments)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        keys.append((value.bitwiseOR(F.lit(k << width)) if width < 58 else value, _masks(width, own)))
    table = fps.select("fp", F.explode(F.array(*[c for c, _ in keys])).alias("key"))
    probes = fps.select("fp", F.explode(F.array(*[c.bitwiseXOR(F.lit(m)) for c, masks in keys for m in masks])).alias("key"))
    hot = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TABLE_ROWS).select("key", F.ceil(F.col("n") / TABLE_ROWS).cast("long").alias("salts"))
    hot = stash(hot, "hot")
    if hot.isEmpty():
        table, probes = (x.select("key", F.lit(side).cast("long").alias("part"), "fp") for x, side in ((table, 0), (probes, 1)))
    else:
        hot = small(hot)
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        table = table.join(hot, "key", "left").select("key", (F.pmod(F.xxhash64("fp"), salts) * 2).alias("part"), "fp")
        probes = probes.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(1).cast("long"), salts * 2 - 1, F.lit(2).cast("long"))).alias("part"), "fp")
    rows = table.unionByName(probes)
    dealt = rows.repartition("key", F.shiftright("part", 1)).sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): alternating large and small stars, written after each round.

    Each star keeps the component and lowers its members' neighbours; rows never exceed the edges, and a round's
    output is on the shared folder, so a lost executor repeats one round at most. A hub's edges stay where they
    are and meet its least neighbour by broadcast.
    """
    spark = edges.sparkSession
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    with scratch(spark) as keep:
        now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        was = state(now)
        while was[0]:
            with scratch(spark) as hand_on:
                both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
                low = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "low")
                large = stash(join_hot(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
                low = stash(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
                star = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
                now = hand_on(stash(join_hot(large, low, "a").select(F.explode(star).alias("e")).select("e.*").where("a <> b").distinct(), "edges"))
            if (new := state(now)) == was:
                break
            was = new
        keep(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node, ...) with root, the least node that the edges reach."""
    return stash(nodes.join(connected(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def _named(rooted: DataFrame) -> DataFrame:
    """rooted (node, low, root, ...) with component_id, the smallest low of the root."""
    lows = stash(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lows")
    return join_hot(rooted, lows, "root")


def components(fp_docs: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """fp_docs (doc_id, fp) with component_id, the smallest doc_id that links reach."""
    fps = stash(fp_docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fps")
    edges = stash(links(fps.select("fp"), radius, segments), "links")
    named = _named(_roots(edges, fps.withColumnRenamed("fp", "node")).withColumnRenamed("n", "rows"))
    named = stash(named.select(F.col("node").alias("fp"), "component_id", F.col("rows").alias("n")), "named")
    return join_hot(fp_docs, named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    with scratch(docs.sparkSession) as keep:
        found = components(stash(fingerprints(docs, width), "fingerprints"), radius, segments)
        return keep(stash(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "near_duplicates"))


#: Wide fingerprints: numbers of 64 bits, segments of 24 bits, radius over the first 128 bits and over all.
LONGS, SEGMENTS, HALF, NEAR, FAR = 9, 24, 12, 31, 115
#: Rows of one half segment, and documents and shingles of one family, that one task holds; more are dealt in tiles.
HALF_ROWS, TILE_DOCS, TILE_SHINGLES = 1 << 20, 4096, 1 << 22
_DENSE = 16


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The different shingle hashes of a text in rising order."""
    return np.unique(shingle_hashes(raw, width))


def set_name(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return md5(s.tobytes()).digest()


def described(docs: DataFrame, width: int) -> DataFrame:
    """row (a number), doc_id, set (its name), size, fp (wide fingerprint) and shingles (32 bits of each) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        for b in pieces(batches):
            sets = [shingle_set(x, width) for x in b.column("raw").to_pylist()]
            columns = [
                pa.array([set_name(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([majority(s, LONGS).tobytes() for s in sets], pa.binary()),
                pa.array([np.unique(s.astype(np.uint32)).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "set", "size", "fp", "shingles"])

    found = docs.select("doc_id", body().cast("binary").alias("raw")).mapInArrow(of, f"doc_id {kind}, set binary, size int, fp binary, shingles binary")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, LONGS)


def _halves(fps: np.ndarray):
    """(key, rest) arrays of each half of each segment: the half names a table, the other half a place in it."""
    raw = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), SEGMENTS, 3).astype(np.int32)
    segment = raw[:, :, 0] | raw[:, :, 1] << 8 | raw[:, :, 2] << 16
    for k in range(SEGMENTS):
        low, high = segment[:, k] & (1 << HALF) - 1, segment[:, k] >> HALF
        yield (2 * k << HALF) + low, high
        yield (2 * k + 1 << HALF) + high, low


def _distance(bits: tuple[np.ndarray, ...], x, y) -> np.ndarray:
    return sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int16) for c in bits)


def _meet(batches):
    """Edges between rows of one table whose places differ by a bit at most and whose first 128 bits by NEAR at most.

    Rows of a full place are first gathered round leaders; two gatherings whose leaders are near need no more, of
    others all rows meet. So a dense group costs about as many comparisons as it has rows, and no link is lost.
    """
    for key, part, rest, node, *bits in _runs(batches, ("key", "part", "rest", "node", "c0", "c1")):
        bits = tuple(c.view(np.uint64) for c in bits)
        table = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        code = (table << HALF) + rest
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(starts[1:], len(code))
        lead = np.arange(len(code))
        for i, j in zip(starts[ends - starts > _DENSE], ends[ends - starts > _DENSE]):
            left = np.arange(i, j)
            while len(left):
                near = _distance(bits, left[0], left) <= NEAR
                lead[left[near]] = left[0]
                left = left[~near]
        far = np.flatnonzero(lead != np.arange(len(code)))
        a, b = [lead[far]], [far]
        heads = np.flatnonzero(lead == np.arange(len(code)))
        many = np.bincount(lead, minlength=len(code))[heads]
        led, places = np.argsort(lead, kind="stable"), code[heads]
        upto = np.append(0, np.cumsum(many))
        for mask in (0, *(1 << n for n in range(HALF))):
            own = np.flatnonzero(places & mask == 0)
            first = np.searchsorted(places, places[own] | mask) if mask else own + 1
            count = np.maximum(np.searchsorted(places, places[own] | mask, "right") - first, 0)
            pairs = np.cumsum(count)
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + _PAIRS)))
                n = count[i:j]
                x = np.repeat(own[i:j], n)
                y = np.repeat(first[i:j] - np.cumsum(n) + n, n) + np.arange(len(x))
                near = _distance(bits, heads[x], heads[y]) <= NEAR
                a.append(heads[x[near]])
                b.append(heads[y[near]])
                unmet = ~near & (many[x] * many[y] > 1)
                for h, g in zip(x[unmet].tolist(), y[unmet].tolist()):
                    these, those = led[upto[h] : upto[h + 1]], led[upto[g] : upto[g + 1]]
                    for at in range(0, len(these), max(1, _PAIRS // len(those))):
                        some = these[at : at + max(1, _PAIRS // len(those))]
                        p, q = np.nonzero(_distance(bits, some[:, None], those[None, :]) <= NEAR)
                        p, q = _forest(some[p], those[q])
                        a.append(p)
                        b.append(q)
                i = j
        a, b = _forest(np.concatenate(a), np.concatenate(b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _runs(batches, columns):
    """Sorted batches as arrays that never part the rows of one value of the first column."""
    left = None
    for b in batches:
        own = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        rows = own if left is None else [np.concatenate(p) for p in zip(left, own)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield [c[:cut] for c in rows]
        left = [c[cut:] for c in rows]
    if left is not None and len(left[0]):
        yield left
    give_back()


def families(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of `sets` (node, fp) that connect what multi-index hashing finds near."""

    def counted(batches):
        n = np.zeros(2 * SEGMENTS << HALF, np.int64)
        for b in batches:
            for key, _ in _halves(_bits(b.column("fp"))):
                n += np.bincount(key, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["key", "n"])

    def halves(batches):
        for b in batches:
            fps, node = _bits(b.column("fp")), b.column("node")
            c0, c1 = (pa.array(np.ascontiguousarray(fps[:, n]).view(np.int64)) for n in (0, 1))
            for key, rest in _halves(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest.astype(np.int16)), node, c0, c1], names=["key", "rest", "node", "c0", "c1"])

    full = sets.select("fp").mapInArrow(counted, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HALF_ROWS)
    full = stash(full.select("key", F.ceil(F.col("n") / HALF_ROWS).cast("int").alias("salts")), "full")
    rows = sets.select("node", "fp").mapInArrow(halves, "key int, rest smallint, node bigint, c0 bigint, c1 bigint")
    if full.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        # there are 2 x 24 x 4096 keys at most; a row of a full one goes to each tile of its salt, so all pairs still meet
        rows = rows.join(F.broadcast(full), "key", "left").withColumn("s", F.coalesce("salts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other")).withColumn("part", F.least("mine", "other") * F.col("s") + F.greatest("mine", "other")).drop("salts", "s", "mine", "other")
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "rest")
    return dealt.mapInArrow(_meet, "a bigint, b bigint").distinct()


def _linked(node: np.ndarray, label: np.ndarray, size: np.ndarray, fps: np.ndarray, shingles: list[bytes]):
    """Edges between the nodes of a tile whose sets have Jaccard similarity 0.8 or more and that `label` doesn't connect yet."""
    counts = np.array([len(x) // 4 for x in shingles])
    _, ids = np.unique(np.frombuffer(b"".join(shingles), "<u4"), return_inverse=True)
    begins = np.append(0, np.cumsum(counts))
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    a, b = [], []
    for x in range(len(node) - 1):
        y = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        y = y[5 * np.minimum(size[y], size[x]) >= 4 * np.maximum(size[y], size[x])]
        y = y[np.bitwise_count(fps[y] ^ fps[x]).sum(axis=1, dtype=np.int64) <= FAR]
        if not len(y):
            continue
        own = ids[begins[x] : begins[x + 1]]
        mark[own] = True
        both = np.array([np.count_nonzero(mark[ids[begins[k] : begins[k + 1]]]) for k in y])
        mark[own] = False
        for k in y[both * 9 >= (counts[y] + counts[x]) * 4].tolist():
            if label[k] != label[x]:
                a.append(node[x])
                b.append(node[k])
                label[label == label[k]] = label[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def _tiles(batches):
    """_linked() over every tile of batches sorted by tile."""
    held, tile = [], None

    def settle():
        node, label, size, fps, shingles = zip(*held)
        return _linked(np.array(node), np.array(label), np.array(size, np.int64), np.frombuffer(b"".join(fps), "<u8").reshape(-1, LONGS), list(shingles))

    for batch in pieces(batches):
        found = []
        for root, part, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "part", "node", "label", "size", "fp", "shingles"))):
            if (root, part) != tile:
                if len(held) > 1:
                    found.append(settle())
                held, tile = [], (root, part)
            held.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], names=["a", "b"])
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(side) for side in settle()], names=["a", "b"])


def _checked(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Links within the tiles of members (root, part, node, label)."""
    own = rows.select(F.col("row").alias("node"), "size", "fp", "shingles").join(small(members), "node")
    return stash(own.repartition("root", "part").sortWithinPartitions("root", "part", "node").mapInArrow(_tiles, "a bigint, b bigint"), "links")


def links_of(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of one family with Jaccard similarity 0.8 or more, which connect what such links connect.

    A family that one task can't hold is dealt into blocks. Each block is settled, then the first node of each
    component of a block meets those of the other blocks, and where more than one component is left, every
    block meets every other.
    """
    edges = stash(families(sets), "near")
    member = _roots(edges, sets.select("node", "size")).withColumnRenamed("node", "member")
    sums = stash(member.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("blocks")).where("n > 1"), "families")
    members = stash(join_hot(member, sums, "root").select("root", F.col("member").alias("node"), F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block"), "blocks"), "members")
    found = _checked(members.select("root", F.col("block").alias("part"), "node", F.col("node").alias("label")), rows)
    wide = members.where("blocks > 1")
    if wide.isEmpty():
        return found

    def labelled(of):
        return _roots(of, wide.select("node", F.col("root").alias("family"), "block", "blocks")).select(F.col("family").alias("root"), "node", "block", "blocks", F.col("root").alias("label"))

    heads = labelled(found).where("node = label")
    many = heads.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TILE_DOCS).cast("int").alias("parts"))
    heads = stash(join_hot(heads, stash(many, "heads"), "root"), "heads")
    found = found.unionByName(_checked(heads.select("root", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part"), "node", "label"), rows))
    label = labelled(found)
    split = label.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("root", "n")
    rest = stash(join_hot(label, stash(split, "split"), "root"), "rest")
    rest = rest.select("root", "node", "label", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
    rest = rest.select("root", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("part"), "node", "label")
    return found.unionByName(_checked(stash(rest, "tiles"), rows))


def alike(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set and component_id of every row: what links of similarity 0.8 or more connect."""
    rows = stash(described(docs, width), "sets")
    sets = stash(rows.groupBy("set").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.count("*").alias("rows")), "sets")
    rooted = _roots(links_of(rows, sets), sets.select("node", "set", "low", "rows"))
    named = stash(_named(rooted).select("set", "component_id", F.col("rows").alias("n")), "named")
    return join_hot(rows.select("doc_id", "set"), named, "set")


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies (the smallest doc_id; of rows with that id one).

    Near copies are texts whose sets of shingles have Jaccard similarity 0.8 or more, and what chains of them connect.
    A row whose doc_id is null stays only if its group has no other row. Columns are those of docs.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(stash(alike(docs, width), "components"))
    own, component, name = unused(docs, "own", "component", "set")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = found.where(~stays).select(F.col("doc_id").alias(own)).distinct()
        return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")

    # ids that several rows carry: such rows are told apart by their sets
    def mark(batches):
        for b in batches:
            names = [set_name(shingle_set((x or "").encode(), width)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.binary())], names=[*b.schema.names, name])

    marked = docs.mapInArrow(mark, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
    marks = found.where(stays).select(F.col("doc_id").alias(own), F.col("component_id").alias(component), F.col("set").alias(f"{name}_")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(name) == F.col(f"{name}_"))
    return marked.join(marks, on).dropDuplicates(["doc_id", component]).select(*docs.columns)
