"""The change feed: the same final state from one batch or from many, stale changes dropped, lexical before vectors."""

import json
import random

from marginalia.operators import incremental
from marginalia.streaming import feed


def write_changes(folder, rows, files):
    folder.mkdir(parents=True, exist_ok=True)
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size : (n + 1) * size]
        (folder / f"{n:03d}.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "generation"), r))) for r in part))


def changes():
    rnd = random.Random(9)
    rows = [(f"n{rnd.randrange(12)}.md", rnd.choice(["upsert", "remove"]), g) for g in range(120)]
    rnd.shuffle(rows)
    return rows


def final(rows):
    best = {}
    for p, k, g in rows:
        if p not in best or g > best[p][1]:
            best[p] = (k, g)
    return best


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = changes()
    write_changes(tmp_path / "in", rows, 6)
    state, order = {}, []

    def lexical(batch, n):
        order.append(("lexical", n))
        for r in batch.collect():
            if r["path"] not in state or r["generation"] > state[r["path"]][1]:
                state[r["path"]] = (r["kind"], r["generation"])

    q = feed.run(feed.changes(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lexical, lambda batch, n: order.append(("vectors", n)))
    q.awaitTermination(120)
    assert state == final(rows) and len(order) == 12
    assert all(order[2 * n] == ("lexical", n) and order[2 * n + 1] == ("vectors", n) for n in range(6))
    one = spark.createDataFrame(rows, feed.CHANGE)
    assert {r["path"]: (r["kind"], r["generation"]) for r in incremental.latest(one).collect()} == final(rows)


def test_stale_changes_are_dropped_across_batches(spark, tmp_path):
    rows = changes()
    write_changes(tmp_path / "in", rows, 4)
    got = []
    stream = feed.newest_only(feed.changes(spark, str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(lambda b, n: got.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    flat = [r for b in got for r in b]
    seen = {}
    for p, _, g in flat:
        assert g > seen.get(p, -1)
        seen[p] = g
    assert seen == {p: g for p, (_, g) in final(rows).items()}


def test_merge_and_reconcile(spark):
    base = spark.createDataFrame([("a", "old a", 1), ("b", "old b", 2), ("c", "old c", 9)], "path string, content string, generation bigint")
    moves = spark.createDataFrame([("a", "upsert", 5), ("a", "upsert", 3), ("b", "remove", 4), ("c", "remove", 7), ("d", "upsert", 6)], feed.CHANGE)
    texts = spark.createDataFrame([("a", 5, "new a"), ("a", 3, "mid a"), ("d", 6, "new d")], "path string, generation bigint, content string")
    assert sorted(tuple(r) for r in incremental.merge(base, moves, texts).collect()) == [("a", "new a", 5), ("c", "old c", 9), ("d", "new d", 6)]
    paths = spark.createDataFrame([(f"p{k:03d}",) for k in range(50)], "path string")
    got = {r["path"]: r["generation"] for r in incremental.initial_generations(paths).collect()}
    assert got == {f"p{k:03d}": k + 1 for k in range(50)}
    work = spark.createDataFrame([("a", "upsert", 2, 0.0), ("b", "remove", 3, 0.0), ("c", "upsert", 1, 99.0), ("d", "awaiting_lexical", 0, 0.0)], "path string, kind string, generation bigint, not_before double")
    assert [r["path"] for r in incremental.due(work, 1.0, 5).collect()] == ["b", "a"]
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, revision string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, revision string")
    assert {r["path"]: r["kind"] for r in incremental.projected(old, new).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "changed"}


def test_feed_keeps_an_index_up(spark, tmp_path):
    import time

    from marginalia.operators import lexical, notes, postings

    texts = {"a.md": "quick fox", "b.md": "slow fox", "c.md": "old fox"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    index = postings.PostingIndex.build(lexical.fields(notes.parse(frame(texts))), f"file://{tmp_path}/index")
    texts["b.md"] = "slow badger"
    contents = lambda paths: frame(texts).join(paths, "path", "left_semi")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path":"b.md","kind":"upsert","generation":1}\n{"path":"a.md","kind":"remove","generation":2}\n')
    stream = feed.newest_only(feed.changes(spark, str(tmp_path / "in")))
    running = feed.run(stream, f"{tmp_path}/checkpoint", feed.index_sink(index, contents), every="200 milliseconds")
    try:
        until = time.time() + 90
        while len(index.segments) < 2 and time.time() < until:
            time.sleep(0.5)
        texts.pop("c.md")
        (tmp_path / "in" / "2.json").write_text('{"path":"c.md","kind":"remove","generation":3}\n{"path":"b.md","kind":"remove","generation":0}\n')
        while len(index.segments) < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        running.stop()
    again = postings.PostingIndex(spark, f"file://{tmp_path}/index", False)
    assert [r["path"] for r in again.search("badger").collect()] == ["b.md"] and again.search("fox").count() == 0
