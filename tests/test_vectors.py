"""Vectors end to end: chunks, embedding with reuse, search, saving, statuses; access rules; offered operations."""

import pytest
from pyspark.sql import functions as F

from marginalia import config
from marginalia.functions import embedders
from marginalia.operators import access, incremental, lexical, vectors
from marginalia.plans.catalogue import chunked, coverage


@pytest.fixture()
def corpus(spark):
    rows = [("a.md", "# Cats\n\ncats purr softly"), ("b.md", "# Dogs\n\ndogs bark loudly"), ("c.md", "cats and dogs\n" + "filler words here. " * 80)]
    return spark.createDataFrame(rows, "path string, content string")


def test_embedding_and_search(spark, corpus, tmp_path):
    chunks = chunked(corpus, 60)
    assert all(r["gaps"] == 0 for r in coverage(chunks).collect())
    embed = embedders.hashing(32)
    none = spark.createDataFrame([], "input_hash string, vector array<float>")
    first = vectors.embed_missing(chunks, none, embed).cache()
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return embed(texts)

    again = vectors.embed_missing(chunks, first.select("input_hash", "vector"), counting)
    assert again.where("vector IS NULL").count() == 0 and calls.value == 0
    query = embed(["cats purr"])[0]
    assert [r["path"] for r in vectors.semantic(first, query, 1).collect()] == ["a.md"]
    assert [r["path"] for r in vectors.semantic(first, query, 5, corpus.where("path <> 'a.md'")).collect()][0] == "c.md"
    name = embedders.identity(model="hash", dim=32)
    vectors.save(first, str(tmp_path), name)
    assert vectors.load(spark, str(tmp_path), name).count() == first.count() and vectors.load(spark, str(tmp_path), "other") is None
    vectors.save(vectors.load(spark, str(tmp_path), name), str(tmp_path), name, first_pass_complete=False)  # over itself
    assert vectors.load(spark, str(tmp_path), name).count() == first.count() and vectors.header(spark, str(tmp_path), name)["first_pass_complete"] is False
    assert vectors.load(spark, str(tmp_path), name, dim=3) is None and vectors.header(spark, str(tmp_path), "other") is None
    kept, ready = incremental.warm_start(vectors.load(spark, str(tmp_path), name), corpus.where("path = 'a.md'"), True)
    assert ready and {r["path"] for r in kept.collect()} == {"a.md"}


@pytest.mark.parametrize(("vector", "query", "want"), [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1.0), ([0.0, 1.0, 0.0], [1.0, 0.0, 0.0], 0.0), ([0.7, 0.7, 0.0], [1.0, 0.0, 0.0], 0.70710678), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], 0.0), ([-1.0, 0.0, 0.0], [1.0, 0.0, 0.0], -1.0), ([1.0, 1.0, 1.0], [0.0, 0.0, 0.0], 0.0)])
def test_cosine(spark, vector, query, want):
    df = spark.createDataFrame([(vector,)], "v array<float>")
    assert abs(df.select(vectors.cosine(F.col("v"), query).alias("c")).first()["c"] - want) < 1e-6


def test_ties_and_hybrid(spark):
    chunks = spark.createDataFrame([("a", 5, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("b", 0, [0.0, 1.0])], "path string, start bigint, vector array<float>")
    best = vectors.best_chunks(chunks, [1.0, 0.0])
    assert {r["path"]: r["start"] for r in best.collect()} == {"a": 2, "b": 0}
    hits = spark.createDataFrame([("b", 1.0)], "path string, score double")  # one without a vector is an error, see below
    assert [(r["path"], r["score"]) for r in vectors.hybrid(hits, best, 5, 0.25).collect()] == [("b", 0.25)]
    equal = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", float("nan"))], "path string, score double")
    assert {r["path"]: r["score"] for r in lexical.normalized(equal).collect()} == {"a": 1.0, "b": 1.0}


def test_replies():
    reply = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert embedders.parse_reply(reply, 2) == [[1.0], [2.0]]
    for bad in ({}, {"data": [{"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [float("nan")]}, {"index": 1, "embedding": [1.0]}]}):
        with pytest.raises(ValueError):
            embedders.parse_reply(bad, 2)
    assert len(embedders.in_batches(embedders.hashing(4), ["x"] * 70)) == 70


def test_access_decisions(spark):
    policy = access.Policy(grants=(access.Rule("w", directory="Work", role="editor"), access.Rule("r", directory="Read"), access.Rule("f", file="one.md")), denies=(access.Rule("d", directory="work/secret"),))
    paths = ["Work/a.md", "Work/Secret/x.md", "Read/b.md", "one.md", "one.mdx", ".obsidian/x.md", "/abs.md", "a/../b.md", "Workshop/a.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["d"]["reason"] for r in df.select("path", access.decision(policy).alias("d")).collect()}
    assert got == dict(zip(paths, ["allowed", "denied", "allowed", "allowed", "no_grant", "reserved_path", "invalid_path", "invalid_path", "no_grant"]))
    writes = {r["path"]: r["d"]["reason"] for r in df.select("path", access.decision(policy, "write").alias("d")).collect()}
    assert writes["Read/b.md"] == "no_grant" and writes["Work/a.md"] == "allowed"
    assert {r["d"]["reason"] for r in df.select(access.decision(access.Policy(enabled=False)).alias("d")).collect()} == {"disabled"}
    folders = {r["path"]: r["c"] for r in spark.createDataFrame([("Work",), ("Work/Secret",), ("Other",), ("Read/deep",)], "path string").select("path", access.container(policy).alias("c")).collect()}
    assert folders == {"Work": True, "Work/Secret": False, "Other": False, "Read/deep": True}
    assert access.guard("Ｗork​/SECRET") == "work/secret"
    for bad in ({"directory": "/x"}, {"file": "a/../b"}, {}, {"directory": "a", "file": "b"}):
        with pytest.raises(ValueError):
            access.Rule("x", **bad)
    fm = "---\ntenant_id: t1\nstar_label: s\nworkspace_id: W9\naudience_kind: channel\naudience_id: C-1\n---\n"
    place = "Organize/Work/slack-w9-channel-c-1/x.md"
    assert access.private_source_eligible(place, fm + "text") and access.private_source_eligible("Distill/slack-w9-channel-c-1/brief.md", fm)
    assert not any(access.private_source_eligible(*x) for x in ((place, "text"), (place, fm + "- [inferred x] y"), ("Notes/x.md", fm), (place, fm.replace("channel", "team")), (place, fm.replace("C-1", "C 1")), (place[:-3], fm)))


def test_offered_operations():
    assert "note_write" not in config.offered("read") and config.offered("search_text, wikilinks, nothing") == {"search_text", "wikilinks"}
    assert len(config.offered()) == 19 and config.offered("!note_write,periodic") == set(config.OPERATIONS) - {"note_write", "periodic"} and len(config.offered("Minimal")) == 6
    with pytest.raises(ValueError):
        config.offered("no_such")


def test_stat_refresh(spark):
    schema = "path string, revision string, size bigint, modified bigint"
    old, new = spark.createDataFrame([("a", "1", 5, 1), ("b", "1", 5, 1), ("c", "1", 5, 1)], schema), spark.createDataFrame([("a", "1", 5, 9), ("b", "2", 6, 9)], schema)
    assert sorted(tuple(r) for r in incremental.refreshed(old, new).collect()) == [("a", "1", 5, 9), ("b", "1", 5, 1), ("c", "1", 5, 1)]


def test_hits_are_guarded(spark):
    from pyspark.errors import PySparkException

    allowed = spark.createDataFrame([("a",), ("b",)], "path string")
    frame = lambda *rows: spark.createDataFrame(list(rows), "path string, score double")
    assert vectors.checked(frame(("a", 1.0), ("b", 0.5)), 2, allowed).count() == 2
    for bad in (frame(("a", 1.0), ("b", 0.5)).unionByName(frame(("a", 0.1))), frame(("c", 1.0))):
        with pytest.raises(PySparkException):
            vectors.checked(bad, 5, allowed).collect()
    with pytest.raises(PySparkException):
        vectors.checked(frame(("a", 1.0), ("b", 0.5)), 1, allowed).collect()
    with pytest.raises(PySparkException):
        vectors.hybrid(frame(("a", 1.0), ("z", 0.5)), frame(("a", 0.5)), 5).collect()
