"""Queries over whole tables, held against plain versions; SQL twins that still cut their input are no measure here."""

from marginalia.functions import chunker
from marginalia.operators import incremental
from marginalia.plans import catalogue
from marginalia.sources import adapters


def test_acl_graph_has_links_of_every_readable_note(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["source"] in ("src1", "src3", "src4", "src5")]
    want = 0
    for r in rows:
        n = r["doc_id"]
        want += (n % 5 != 3) * (1 + (n % 4 == 0) + (n % 6 == 0))
    got = catalogue.QUERIES["acl_graph"](spark, sf).collect()
    assert len(got) == want
    assert any(int(r["source"].rsplit("-", 1)[1][:-3]) % 2 == 0 for r in got if "/doc-" in r["source"])
    assert all(r["resolved"] is None or r["resolved"].split("/")[0] in ("src1", "src3", "src4", "src5") for r in got)


def test_plan_batches_plans_every_document(spark):
    import random

    rnd = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for count in (1, 7, 700):
        sizes = [rnd.choice((10, 900, 4000, 9000, 19_999, 25_000)) for _ in range(count)]
        want, at, batch = {}, 0, 0
        while at < count:
            n = chunker.plan_batch(sizes[at:], 8, 20_000)
            want |= {k: batch for k in range(at, at + n)}
            at, batch = at + n, batch + 1
        df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
        got = {r["doc_id"]: r["batch"] for r in catalogue.batches(df, 8, 20_000).collect()}
        assert got == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plan_batches_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").collect())
    want, at, batch = {}, 0, 0
    while at < len(rows):
        n = chunker.plan_batch([s for _, s in rows[at:]], 8, 20_000)
        want |= {i: batch for i, _ in rows[at : at + n]}
        at, batch = at + n, batch + 1
    assert {r["doc_id"]: r["batch"] for r in catalogue.QUERIES["plan_batches"](spark, sf).collect()} == want


def test_reconcile_removed_returns_every_removed_path(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    want = {f"{r['source']}/doc-{r['doc_id']}.md" for r in rows if r["doc_id"] % 13 and r["doc_id"] % 7 == 0}
    assert {r["path"] for r in catalogue.QUERIES["reconcile_removed"](spark, sf).collect()} == want


def test_later_changes_are_left_alone(spark):
    was = spark.createDataFrame([("a", 1), ("b", 5), ("c", 6), ("d", 2)], "path string, generation bigint")
    now = spark.createDataFrame([("d",)], "path string")
    assert {r["path"] for r in incremental.removed(was, now, 5).collect()} == {"a", "b"}
    assert {r["path"] for r in incremental.removed(was, now).collect()} == {"a", "b", "c"}


def test_composed_notes_hold_whole_texts(spark):
    text = "first " + "filler " * 400 + "last"
    docs = spark.createDataFrame([(1, text, "en", "src1")], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert text in adapters.composed_notes(docs, labels).first()["content"]
