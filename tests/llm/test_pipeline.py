"""Each stage of the pipeline against a plain version of itself."""

from collections import Counter
from hashlib import md5

import pytest

import corpus_pipeline
from marginalia.llm import near_dup, op3_shard, op8_toxicity, op10_decontaminate

STAGES = dict(corpus_pipeline.STAGES)


def similar(a, b, width=5):
    x, y = ({s.tobytes() for s in near_dup.shingle_hashes(t.encode(), width)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_toxicity_keeps_what_scores_low(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    index = op8_toxicity.fit(docs, labels)
    want = {r["doc_id"] for r in docs.collect() if index.score(r["text"])[0] < 0.5}
    out = STAGES["toxicity"](spark, docs, sf)
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == docs.columns


def jaccard_roots(texts):
    """The least id that chains of pairs with similarity 0.8 or more reach, over all pairs."""
    sets = {i: {s.tobytes() for s in near_dup.shingle_hashes(t.encode(), 5)} for i, t in texts.items()}
    root, links = {i: i for i in texts}, []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                links.append((a, b))
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in ids}, links


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        roots, links = jaccard_roots({r["doc_id"]: r["text"] for r in docs.collect()})
        kept = {r["doc_id"] for r in STAGES["simhash near-dedup"](spark, docs, d).collect()}
        assert links and kept == {i for i in roots if roots[i] == i}


def edited(rnd, words, base, share):
    ws = list(base)
    for _ in range(max(1, round(share * len(ws)))):
        ws[rnd.randrange(len(ws))] = words()
    return ws


@pytest.mark.parametrize("docs_a_tile", [near_dup.TILE_DOCS, 16])
def test_dense_groups_equal_brute_force(spark, monkeypatch, docs_a_tile):
    """Groups of edits of one text, near and below the threshold, also where no task may hold a whole group or table."""
    import random

    monkeypatch.setattr(near_dup, "TILE_DOCS", docs_a_tile)
    monkeypatch.setattr(near_dup, "HALF_ROWS", 8 * docs_a_tile)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for share in (0.005, 0.02, 0.03, 0.04):
        base = [word() for _ in range(200)]
        texts += [" ".join(edited(rnd, word, base, share)) for _ in range(60)]
    texts = dict(enumerate(texts))
    roots, links = jaccard_roots(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.alike(df, 5).collect()}
    assert len(links) > 1000 and got == roots


def test_recall_of_single_pairs(spark):
    """Pairs on their own, at the threshold and just above: no third text helps to find them."""
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = {}
    for k in range(400):
        base = [word() for _ in range(150)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(edited(rnd, word, base, 0.02))
    pairs = [k for k in range(400) if 0.8 <= similar(texts[2 * k], texts[2 * k + 1]) < 0.85]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.alike(df, 5).collect()}
    assert len(pairs) > 60 and sum(got[2 * k + 1] == 2 * k for k in pairs) >= 0.9 * len(pairs)
    assert all(similar(texts[i], texts[c]) >= 0.8 for i, c in got.items() if i != c)


def test_near_duplicates_equal_brute_force_jaccard(spark):
    import random

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for size in (30, 60, 120, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            rows.append(base)
            for _ in range(8):
                ws = list(base)
                for _ in range(rnd.randrange(1, max(2, size // 25) + 1)):
                    ws[rnd.randrange(size)] = word()
                rows.append(ws)
    texts = {i: " ".join(ws) for i, ws in enumerate(rows)}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a in texts:
        for b in range(a + 1, len(texts)):
            s = similar(texts[a], texts[b])
            near += 0.6 <= s < 0.8
            if s >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert near > 50
    assert {r["doc_id"] for r in near_dup.deduplicate(df).collect()} == {i for i in texts if top(i) == i}


def test_decontamination_removes_passages(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = op10_decontaminate.Passages([(r["item_id"], r["text"]) for r in items.collect()])
    want = {r["doc_id"] for r in docs.collect() if not found.find([r["text"]])}
    assert {r["doc_id"] for r in STAGES["benchmark decontamination"](spark, docs, sf).collect()} == want


def test_mixing_follows_rates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    whole = Counter()
    for r in rows:
        whole[r["source"]] += size[r["doc_id"]]
    goal, stopped = {}, set()
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(whole))}
    while True:
        rest = 1.5 * sum(whole.values()) - sum(2 * whole[s] for s in stopped)
        free = [s for s in whole if s not in stopped]
        goal = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if goal[s] > 2 * whole[s]}
        if not over:
            break
        stopped |= over
    goal |= {s: 2.0 * whole[s] for s in stopped}
    want = Counter()
    for r in rows:
        rate = goal[r["source"]] / whole[r["source"]]
        draw = int(md5(f"0:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        want[r["doc_id"]] = int(rate) + (draw < rate - int(rate))
    got = Counter(r["doc_id"] for r in STAGES["mixing to target weights"](spark, docs, sf).collect())
    assert got == +want
    taken = Counter()
    for r in rows:
        taken[r["source"]] += size[r["doc_id"]] * want[r["doc_id"]]
    assert abs(sum(taken.values()) - sum(goal.values())) < 0.1 * sum(goal.values())


def test_sharding_follows_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = op3_shard.fill()
    for r in STAGES["sharding"](spark, docs, sf).collect():
        slot = int(md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % op3_shard.SLOTS
        assert (r["slot"], r["shard"]) == (slot, op3_shard.SHARDS[table[slot]])
