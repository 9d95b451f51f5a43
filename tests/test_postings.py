"""The written lexical index against the form without an index, through replacement, removal and views."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions.stemmer import stem
from marginalia.operators import lexical, notes, postings

NOTES = {
    "a.md": "---\ntags: [code/rust]\nkind: language\n---\n# Rust notes\n\nProgramming in rust, programs that run quickly\n",
    "b.md": "# Python\n\nRunning a program; python scripts and the quick brown fox\n",
    "c.md": "# Cooking\n\nThe fox runs from the quick cook\n",
    "d.md": "",
}


def corpus(spark, texts, stems=False):
    return lexical.fields(notes.parse(spark.createDataFrame(list(texts.items()), "path string, content string")), stems)


def same(a, b):
    a, b = ({r["path"]: r["score"] for r in x.collect()} for x in (a, b))
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and bool(a)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return postings.PostingIndex.build(corpus(spark, NOTES), f"file://{tmp_path_factory.mktemp('plain')}")


@pytest.mark.parametrize("query", ["fox", "quick fox rust", '"quick brown fox"', '"brown quick"', "+fox -cook", "the AND quick", "title:a OR python", "tags:code", "+(rust OR python) -title:b", "nothing"])
def test_queries_equal_the_form_without_index(spark, plain, query):
    want = lexical.search(corpus(spark, NOTES), query, 10).collect()
    got = plain.search(query, 10).collect()
    assert [r["path"] for r in got] == [r["path"] for r in want]
    assert all(abs(x["score"] - y["score"]) < 1e-9 for x, y in zip(got, want))


def test_fuzzy_and_facets(spark, plain):
    own = corpus(spark, NOTES)
    assert same(plain.fuzzy_scores(["rast", "foy"]), lexical.fuzzy_scores(own, ["rast", "foy"]))
    assert same(plain.facet_scores(["code"]), lexical.facet_scores(own, ["code"]))


def test_replacing_removing_and_compacting(spark, tmp_path):
    index = postings.PostingIndex.build(corpus(spark, NOTES, True), f"file://{tmp_path}/i", stems=True)
    assert {r["path"] for r in index.search("programs").collect()} == {"a.md", "b.md"}
    now = NOTES | {"b.md": "# Snakes\n\nno more code, only snakes running\n", "e.md": "a new program\n"}
    index.replace(corpus(spark, {k: now[k] for k in ("b.md", "e.md")}, True))
    index.remove(spark.createDataFrame([("c.md",)], "path string"))
    now.pop("c.md")
    want = lexical.scores(corpus(spark, now, True), ["program", "run", "snake"])
    assert same(index.scores(["program", "run", "snake"]), want) and len(index.segments) == 3
    again = postings.PostingIndex(spark, f"file://{tmp_path}/i", True)
    assert same(again.scores(["program", "run", "snake"]), want)
    again.compact()
    assert len(again.segments) == 1 and same(postings.PostingIndex(spark, f"file://{tmp_path}/i", True).scores(["program", "run", "snake"]), want)
    seen = again.view(F.col("path") != "a.md")
    now.pop("a.md")
    assert same(seen.scores(["program", "run"]), lexical.scores(corpus(spark, now, True), ["program", "run"]))
    with pytest.raises(PermissionError):
        seen.remove(spark.createDataFrame([("e.md",)], "path string"))


def test_notes_with_equal_counts_have_equal_scores(spark, tmp_path, monkeypatch):
    """Sums don't hang on the order in which terms and fields come, so ties go to the smaller path."""
    index = postings.PostingIndex.build(corpus(spark, NOTES), f"file://{tmp_path}/i")
    counts = [(t, f, n, 7 * n + m) for n, t in enumerate(("fox", "quick", "runs", "notes", "the"), 1) for m, f in enumerate(("headings", "frontmatter", "body"), 1)]
    rows = [(t, f, f"{k}.md", tf, dl) for k in range(9) for t, f, tf, dl in counts[k:] + counts[:k]]
    found = spark.createDataFrame(rows, "term string, field string, path string, tf int, dl int").coalesce(1)
    monkeypatch.setattr(index, "postings", lambda *_: found)
    got = index.search("fox quick runs notes the", 9).collect()
    assert len({r["score"] for r in got}) == 1 and [r["path"] for r in got] == [f"{k}.md" for k in range(9)]


def test_ranking_on_rounded_scores(spark):
    found = spark.createDataFrame([("b", 1.0000004), ("a", 1.0), ("c", 0.5), ("d", 2.0)], "path string, score double")
    assert [r["path"] for r in lexical.top(found, 2, digits=6).collect()] == ["d", "a"]
    assert [r["path"] for r in lexical.top(found, 2).collect()] == ["d", "b"]


@pytest.mark.parametrize("stems", [False, True])
@pytest.mark.parametrize("most", [1, 12, 10**6])
def test_postings_are_counted_in_bounded_parts(monkeypatch, stems, most):
    monkeypatch.setattr(postings, "PART_TOKENS", most, raising=False)
    words = [[], None, ["runs", "running", "fox", "x" * 40, "runs", "é" * 20], ["fox"], ["the"] * 20, ["a", "b", "a"]]
    fields = {f: [w[:n] if w else w for w in words] for n, f in enumerate(postings.FIELDS, 2)}
    batch = pa.RecordBatch.from_pydict({"path": [f"{n // 2}.md" for n in range(6)]} | {f: pa.array(w, pa.list_(pa.string())) for f, w in fields.items()})
    made = list(postings._inverted(stems)(iter([batch.slice(0, 0), batch])))
    want = []
    for f, texts in fields.items():
        for n, ws in enumerate(texts):
            ws = [stem(w) for w in ws or [] if len(w.encode()) < 40] if stems and f != "facets" else ws or []
            want += [(w, f, f"{n // 2}.md", ws.count(w), len(ws), [k for k, x in enumerate(ws) if x == w]) for w in dict.fromkeys(ws)]
    assert sorted(tuple(r.values()) for b in made for r in b.to_pylist()) == sorted(want)
    assert most > 12 or all(b["tf"].to_pylist() and (sum(b["tf"].to_pylist()) <= most or len(set(b["path"].to_pylist())) == 1) for b in made)


def test_empty_index(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/none", False)
    assert index.search("x").count() == 0
    index.replace(corpus(spark, NOTES).limit(0))
    assert index.search("fox").count() == 0


def test_only_the_terms_buckets_are_read(spark, plain):
    found = plain.postings(["fox"])
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == {str(b) for b in postings._buckets(["fox"])}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "term" in plan.split("PushedFilters")[1].split("]")[0] and found.count() == 2
