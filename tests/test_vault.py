"""A small vault end to end, against values worked out by hand."""

from datetime import date

import pytest

from marginalia.operators import access
from marginalia.vault import Vault

NOTES = {
    "Daily/2026-03-19.md": "---\ntags: [daily]\n---\n# 2026-03-19\n\nSaw [[beta]] and [[alpha|the first]].\n",
    "Work/alpha.md": "---\ntags: [work, work/deep]\nstatus: active\npriority: 2\nnothing: null\n---\n# Alpha\n\nQuantum cats run. #inline\n\n## Plan\n\nStep one ^step\n\n### Detail\n\nmore\n\n## End\n\nlast\n",
    "Work/beta.md": "# Beta\n\n[[Work/alpha]] [[missing]] ![[pic.png]]\n\n```\n#nottag [[notlink]]\n```\n",
    "twin.md": "one twin\n",
    "old/twin.md": "other twin [[gone]]\n",
    "links.md": "see [[twin]] and [[alpha#Plan]]\n",
    "bad.md": "---\na: [\n---\nbody [[alpha]]\n",
}


@pytest.fixture()
def vault(spark, tmp_path):
    for p, c in NOTES.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(c)
    (tmp_path / "pic.png").write_bytes(b"12345")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("hidden")
    return Vault.open(spark, str(tmp_path))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_parsing_and_stats(vault):
    s = vault.stats().first()
    assert (s["notes"], s["files"], s["excluded"]) == (6, 7, 0)
    assert s["tags"] == 4 and s["links"] == 8
    assert rows(vault.rejected(), "path") == [("bad.md",)]


def test_graph(vault):
    assert rows(vault.backlinks("Work/alpha.md"), "source") == [("Daily/2026-03-19.md",), ("Work/beta.md",), ("links.md",)]
    assert rows(vault.broken_links(), "source", "target") == [("Work/beta.md", "missing"), ("Work/beta.md", "pic.png"), ("links.md", "twin"), ("old/twin.md", "gone")]
    assert rows(vault.orphans(), "path", "kind") == [("old/twin.md", "broken_outgoing_only"), ("twin.md", "no_links")]
    assert vault.inspect("Work/alpha.md").first()["backlinks"] == 3


def test_policy_views_have_their_own_graph(vault):
    seen = vault.visible_to(access.Policy(grants=(access.Rule("all", directory=""),), denies=(access.Rule("no", directory="old"),)))
    assert rows(seen.broken_links(), "source", "target") == [("Work/beta.md", "missing"), ("Work/beta.md", "pic.png")]
    with pytest.raises(PermissionError):
        seen.write("twin.md", "x")


def test_filters(vault):
    assert rows(vault.by_tag("#Work"), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_tag("inline", nested=False), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_tag("wor"), "path") == []
    assert rows(vault.by_property("status", "eq", "active"), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_property("status", "contains", "ctiv"), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_property("tags", "contains", "work"), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_property("tags", "contains", "wor"), "path") == []
    assert rows(vault.by_property("priority", "eq", 2), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_property("nothing", "exists"), "path") == [("Work/alpha.md",)]
    assert rows(vault.by_property("absent", "exists"), "path") == []
    with pytest.raises(ValueError):
        vault.by_property("status", "like", "x")


def test_search(vault):
    assert [r["path"] for r in vault.search_text("alpha").collect()][0] == "Work/alpha.md"
    assert rows(vault.search_text('"quantum cats" -missing'), "path") == [("Work/alpha.md",)]
    assert rows(vault.search_text("quantun", fuzzy=True), "path") == [("Work/alpha.md",)]
    assert rows(vault.search_text("running"), "path") == [("Work/alpha.md",)]  # by its stem
    vault.write("Work/beta.md", "runs")
    assert rows(vault.search_text("running"), "path") == [("Work/alpha.md",), ("Work/beta.md",)]
    vault.move("Work/beta.md", "Work/gamma.md")
    seen = vault.visible_to(access.Policy(grants=(access.Rule("all", directory=""),), denies=(access.Rule("no", file="Work/alpha.md"),)))
    assert rows(vault.search_text("running"), "path") == [("Work/alpha.md",), ("Work/gamma.md",)] and rows(seen.search_text("running"), "path") == [("Work/gamma.md",)]
    vault.delete("Work/gamma.md", confirm=True)
    assert rows(vault.search_text("running"), "path") == [("Work/alpha.md",)]
    assert rows(vault.search_text("work", fields=["tags"]), "path") == [("Work/alpha.md",)]
    hit = vault.search_regex("t[aw]in", context=4).collect()
    assert [r["path"] for r in hit] == ["links.md", "old/twin.md", "twin.md"]
    m = hit[2]["matches"][0]
    assert (m["context"], m["start"], m["end"], m["line"]) == ("one twin\n", 4, 8, 0)
    with pytest.raises(ValueError):
        vault.search_regex("(?=x)")


def test_reading(vault):
    page = vault.read("twin.md", (0, 9), max_bytes=4)
    assert (page["content"], page["next"]) == ("one ", 4)
    with pytest.raises(ValueError):
        vault.read("twin.md", expected_revision="0" * 64)
    assert rows(vault.list_files("Work"), "path") == [("Work/alpha.md",), ("Work/beta.md",)]
    assert vault.tree("Work") == "└── Work\n    ├── alpha.md\n    └── beta.md"
    many = {r["path"]: r for r in vault.read_many("", recursive=True, max_bytes=100).collect()}
    assert all(r["content"] == (NOTES[p] if r["taken"] else None) for p, r in many.items()) and many["Daily/2026-03-19.md"]["taken"]
    assert many["Work/alpha.md"]["skipped"] == "larger than the budget" and "no room left" in {r["skipped"] for r in many.values()}
    assert vault.targets("Work/alpha.md") == {"headings": ["# Alpha", "## Plan", "### Detail", "## End"], "blocks": ["step"], "frontmatter_keys": ["tags", "status", "priority", "nothing"]}
    assert rows(vault.headings("Work/alpha.md"), "ordinal", "text", "level")[2] == (2, "Detail", 3)
    assert rows(vault.headings("Work/alpha.md", 2, 1), "text", "preview") == [("Detail", "### Detail\n\nmore\n\n")]
    assert len(vault.headings("Work/alpha.md", max_bytes=1).collect()) == 1
    assert [r["parent"] for r in vault.headings("Work/alpha.md").collect()] == [None, 0, 1, 0]


def test_mutation(vault):
    vault.create("new.md", "text", {"a": 1})
    with pytest.raises(FileExistsError):
        vault.create("new.md")
    assert vault.read("new.md")["content"] == "---\na: 1\n---\ntext"
    vault.insert("new.md", "first", "beginning")
    vault.insert("new.md", "last\n")
    assert vault.read("new.md")["content"] == "---\na: 1\n---\nfirst\ntext\nlast\n"
    vault.set_property("new.md", "b", ["x"])
    vault.remove_property("new.md", "a")
    assert vault.frontmatter("new.md") == {"b": ["x"]}
    vault.patch("Work/alpha.md", "append", "heading", "Alpha::Plan", "added")
    assert "more\n\nadded\n## End" in vault.read("Work/alpha.md")["content"]
    vault.move("new.md", "moved/new.md")
    assert ("moved/new.md",) in rows(vault.list_files(recursive=True), "path")
    with pytest.raises(ValueError):
        vault.delete("moved/new.md")
    vault.delete("moved/new.md", confirm=True)
    with pytest.raises(FileNotFoundError):
        vault.read("moved/new.md")
    with pytest.raises(ValueError):
        vault.write("../out.md", "x")


def test_periodic(vault):
    assert vault.periodic_create("weekly", date(2026, 3, 19), "w") == "2026-W12.md"
    assert vault.periodic_list("weekly") == [(date(2026, 3, 16), "2026-W12.md")]
    assert vault.periodic_get("weekly", date(2026, 3, 17))["content"] == "w"


def test_semantic_search_by_text_with_evidence(spark, vault):
    chunks = [("Work/alpha.md", 76, 140, [1.0, 0.0]), ("twin.md", 0, 8, [0.6, 0.8]), ("links.md", 500, 600, [0.0, 1.0]), ("gone.md", 0, 1, [1.0, 0.0])]
    vault.chunk_vectors = spark.createDataFrame(chunks, "path string, start bigint, end bigint, vector array<double>")
    got = vault.search_semantic_text("cats run", lambda text: [1.0, 0.1], 10, None).collect()
    assert [r["path"] for r in got] == ["Work/alpha.md", "twin.md", "links.md"]
    assert "cats run" in got[0]["preview"] and [r["status"] for r in got] == ["current", "current", "changed"]
    with pytest.raises(ValueError):
        vault.search_semantic_text("  ", lambda text: [1.0, 0.0])


def test_oversized_notes_are_named(spark, vault, monkeypatch):
    from marginalia.sources import folder

    monkeypatch.setattr(folder, "MAX_SOURCE_BYTES", 60)
    small = Vault.open(spark, vault.root)
    assert ("Work/alpha.md",) in rows(small.rejected(), "path") and ("Work/alpha.md",) not in rows(small.parsed, "path")


def test_search_reads_unicode(spark):
    corpus = spark.createDataFrame([("a.md", "une ÉCOLE"), ("b.md", "room ４２"), ("c.md", "A b\u2028c")], "path string, content string")
    vault = Vault(spark, corpus)
    assert rows(vault.search_regex(r"(?i)école"), "path") == [("a.md",)] and rows(vault.search_regex(r"\d+"), "path") == [("b.md",)]
    assert rows(vault.search_regex(r"\p{Lu}"), "path") == [("a.md",), ("c.md",)] and rows(vault.search_regex("b.c"), "path") == [("c.md",)]
    assert vault.search_regex(r"\p{Nd}+").first()["matches"][0]["context"] == "room ４２"


def test_guarded_denies(spark):
    paths = ["ｓecret/a.md", "se\u200bcret/a.md", "secret\ufe0f/a.md", "SECRET/a.md", "secret/a.md", "\uff0eh/a.md", "con.md", "a/b.md", "\u2024x/y.md", "ſecret/a.md"]
    corpus = spark.createDataFrame([(p, "x") for p in paths], "path string, content string")
    policy = access.Policy(grants=(access.Rule("all", directory=""),), denies=(access.Rule("no", directory="secret"),))
    assert rows(Vault(spark, corpus).visible_to(policy)._corpus, "path") == [("a/b.md",)]
