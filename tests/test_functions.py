"""Cases for the pure functions: front matter, Markdown, paths, dates, stems, chunks, query syntax."""

import random
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions import chunker, frontmatter, markdown, paths, periodic
from marginalia.functions.stemmer import stem
from marginalia.operators import lexical, search


@pytest.mark.parametrize(
    ("content", "raw", "start"),
    [("---\na: 1\n---\nx", "a: 1\n", 13), ("---\r\na: 1\r\n---\r\nx", "a: 1\r\n", 16), ("---\n---\n", "", 8), (" ---\na: 1\n---\n", None, 0), ("---\na: 1\n", None, 0), ("---\na: 1\n---", "a: 1\n", 12), ("----\na\n---\n", None, 0)],
)
def test_frontmatter_split(content, raw, start):
    assert frontmatter.split(content) == (raw, start)


def test_frontmatter_values():
    fm = frontmatter.parse("---\nd: 2026-03-19\nyes: yes\nn: 012\nf: 2.0\nt: 12:30\nl: [a, 1, null]\nc: 'x, y,,'\n---\n")
    assert fm == {"d": "2026-03-19", "yes": "yes", "n": 12, "f": 2.0, "t": "12:30", "l": ["a", 1, None], "c": "x, y,,"}
    assert frontmatter.string_list(fm, "l") == ["a", "1"] and frontmatter.string_list(fm, "c") == ["x", "y"] and frontmatter.string_list(fm, "n") == []
    assert frontmatter.canonical(2) != frontmatter.canonical(2.0)
    assert frontmatter.parse("---\n---\n") == {} and frontmatter.parse("x") is None
    for bad in ("---\n- a\n---\n", "---\na: [\n---\n"):
        with pytest.raises(frontmatter.FrontmatterError):
            frontmatter.parse(bad)
    assert frontmatter.search_text({"a": [1, None, True], "b": {"c": "x"}}) == "a 1 true b c x"


def test_headings_and_code():
    text = "Title\n=====\n\n# One {#id}\ntext\n## Two `code` **bold** ##\n\n```\n# no\n```\n\n    # no\n\n> # Quoted\n\nSub\n---\n#no\n"
    s = markdown.structure(text)
    assert [(h.level, h.text) for h in s.headings] == [(1, "Title"), (1, "One"), (2, "Two code bold"), (1, "Quoted"), (2, "Sub")]
    assert [b.kind for b in s.blocks] == ["heading", "heading", "paragraph", "heading", "code", "code", "quote", "heading", "paragraph"]


def test_inline_tags_links_blocks():
    text = "#a #b/c x#d `#e` #A\n[[t|al]] [[u#H]] [[v#^b]] [[w|]] `[[no]]`\nend ^id1\n\n~~~\n^no\n~~~\n"
    code = markdown.structure(text).code
    assert markdown.inline_tags(text, code) == ["A", "a", "b/c"]
    assert [(x["target"], x["heading"], x["block_ref"], x["alias"], x["line"]) for x in markdown.wikilinks(text, code)] == [("t", None, None, "al", 1), ("u", "H", None, None, 1), ("v", None, "b", None, 1), ("w", None, None, None, 1)]
    assert markdown.block_ids(text, code) == ["id1"]


@pytest.mark.parametrize(
    ("operation", "kind", "target", "text", "content", "want"),
    [
        ("append", "heading", "A", "new", "# A\nx\n# B\n", "# A\nx\nnew\n# B\n"),
        ("prepend", "heading", "A", "new", "# A\nx\n", "# A\nnew\nx\n"),
        ("replace", "heading", "A::B", "new", "# A\n## B\nx\n## C\ny\n", "# A\n## B\nnew\n## C\ny\n"),
        ("replace", "heading", "## a", "new", "## A\nx", "## A\nnew"),
        ("replace", "block", "^k", "new", "old ^k\n", "new ^k\n"),
        ("append", "block", "k", "new", "old ^k\r\nz\r\n", "old ^k\r\nnew\r\nz\r\n"),
        ("prepend", "block", "k", "new", "a\nold ^k", "a\nnew\nold ^k"),
        ("append", "frontmatter", "l", "b", "---\nl: [a]\n---\nx", "---\nl:\n  - a\n  - b\n---\nx"),
        ("append", "frontmatter", "s", "b", "---\ns: a\n---\nx", "---\ns: ab\n---\nx"),
        ("replace", "frontmatter", "s", "2", "---\ns: a\n---\nx", "---\ns: 2\n---\nx"),
    ],
)
def test_patch(operation, kind, target, text, content, want):
    assert markdown.patch(content, operation, kind, target, text) == want


def test_patch_without_target():
    for kind in ("heading", "block", "frontmatter"):
        with pytest.raises(KeyError):
            markdown.patch("text\n", "append", kind, "x", "y")


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("a/**", "a/b/c.md", True), ("a/**", "ab/c.md", False), ("*.md", "a/b.md", True), ("**/x.md", "x.md", True), ("**/x.md", "a/x.md", True), ("a?.md", "ab.md", True), ("[!a].md", "b.md", True), ("{a,b}.md", "b.md", True), ("a.md", "axmd", False)],
)
def test_globs(pattern, path, want):
    import re

    assert bool(re.search(paths.glob_regex(pattern), path)) is want


def test_paths():
    assert paths.exclusion_rules(["b/", "a"], ["b/"]) == ["a", "b/**"]
    assert paths.link_key("Café\\X.MD") == "café/x"
    assert paths.scope_id("r", ["a", "b"]) == paths.scope_id("r", ["b", "a"]) != paths.scope_id("r", ["ab"])
    assert [paths.is_markdown(p) for p in ("a.md", "x/.md", "b.MD", "c.txt")] == [True, False, True, False]
    for bad in ("/a", "../a", "a/../../b", "a\x00b", "\\a"):
        with pytest.raises(ValueError):
            paths.normalize(bad)
    with pytest.raises(ValueError):
        paths.glob_regex("[a")
    assert paths.ignore_lines("# c\n\n a/ \n") == ["a/"]


def test_periodic_round_trips():
    rnd = random.Random(5)
    for _ in range(300):
        d = date.fromordinal(rnd.randrange(date(1990, 1, 1).toordinal(), date(2040, 1, 1).toordinal()))
        for period, fmt in periodic.DEFAULTS.items():
            assert periodic.parse_date(periodic.format_date(d, fmt), fmt) == periodic.period_start(d, period)
    assert periodic.format_date(date(2026, 3, 5), "[at] D/M/YY dddd Do") == "at 5/3/26 Thursday 5"
    assert periodic.parse_date("2026-13-01", "YYYY-MM-DD") is None and periodic.parse_date("2026-Q5", "YYYY-[Q]Q") is None
    with pytest.raises(ValueError):
        periodic.format_date(date(2026, 1, 1), "HH")
    assert periodic.expand_template("{{date:YYYY}} {{title}} {{date}}", date(2026, 1, 2), "t") == "2026 t 2026-01-02"
    assert [periodic.retry_delay(n) for n in (1, 2, 5, 6, 9)] == [1, 2, 16, 30, 30]
    assert periodic.config("daily", None, '{"folder": "D"}')["folder"] == "D"
    assert periodic.config("weekly", '{"weekly": {"enabled": true, "format": "gggg"}}')["format"] == "gggg"


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("generously", "generous"), ("happy", "happi"), ("relational", "relat"), ("ties", "tie"), ("cries", "cri"), ("hoped", "hope"), ("hopping", "hop"), ("luxuriating", "luxuri"), ("skis", "ski"), ("proceed", "proceed"), ("by", "by"), ("say", "say"), ("nationally", "nation"), ("consolingly", "consol")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_chunks_cover_notes():
    rnd = random.Random(3)
    parts = ["# Head {}\n\n", "word one. Two three! ", "é ü long words herein\n", "\n\n", "- item\n- more\n", "```\ncode here\n```\n", "x" * 90, "## Sub\n"]
    for _ in range(60):
        text = ("---\na: 1\n---\n" if rnd.random() < 0.3 else "") + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        body = frontmatter.split(text)[1]
        got = chunker.chunks("t", text, 40)
        if not text[body:].strip():
            assert got == []
            continue
        assert got[0]["start"] == len(text[:body].encode()) and got[-1]["end"] == len(text.encode())
        assert all(a["end"] == b["start"] for a, b in zip(got, got[1:]))
    assert chunker.plan_batch([5, 5, 5], 2, 100) == 2 and chunker.plan_batch([500, 5], 9, 100) == 1
    with pytest.raises(ValueError):
        chunker.validate_vectors([[1.0, float("nan")]], 1, 2)


def test_query_grammar():
    t = lexical.parse_query('+rust -java "quick fox" title:x (a OR b)')
    assert len(t["must"]) == 1 and len(t["must_not"]) == 1 and len(t["should"]) == 3
    assert lexical.tree_terms(t) == ["rust", "quick", "fox", "x", "a", "b"]
    assert [len(lexical.parse_query("a AND b")[k]) for k in ("must", "should")] == [2, 0]
    for bad in ("(a", "a)", "nofield:x", "a OR"):
        with pytest.raises(lexical.QueryError):
            lexical.parse_query(bad)


def test_contexts_keep_characters_whole():
    import re

    m = search.contexts("ééx\nyéé", re.compile("x\ny"), 3)[0]
    assert m["context"] == "ééx\nyéé"[m["context"] and "ééx\nyéé".index(m["context"]) :][: len(m["context"])]
    assert m["context"][m["start"] : m["end"]] == "x\ny" and m["line"] == 0
    assert search.preview("a" * 400 + " needle " + "b" * 400, "needle").count("needle") == 1
    assert search.page("aé", 0, None, 2) == {"content": "a", "start": 0, "end": 1, "next": 1}


@given(st.text(alphabet="ab .\n#é漢", max_size=400), st.integers(3, 30))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_fit_and_end_well(text, limit):
    raw = text.encode()
    try:
        got = chunker.chunks("t", text, limit)
    except chunker.TooLong:
        return
    at = got[0]["start"] if got else len(raw)
    assert bool(got) == bool(text[len(raw[:0]) :].strip()) or frontmatter.split(text)[1]
    for c in got:
        assert c["start"] == at and chunker.word_count(c["text"]) <= limit
        own = raw[c["start"] : c["end"]].decode()
        assert c["text"].endswith(own) and (c["overlap_start"] is None or raw[c["overlap_start"] : c["end"]].decode() in c["text"])
        at = c["end"]
    assert not got or at == len(raw)


def test_chunk_cuts():
    words = " ".join(f"w{k}" for k in range(60))
    cut = lambda text, limit, count=chunker.word_count: [c["text"].split("\n", 1)[1] for c in chunker.chunks("t", text, limit, count)]
    sentence = "One two three. Four five six! Seven eight"
    assert [raw for raw in cut(sentence, 5)][0] == "One two three."  # a sentence's end before a word's
    assert cut("a b\nc d e f g h i j k l m n o p q r s t", 6)[0] == "a b\n"  # a line's end before a word's
    long = chunker.chunks("t", words, 20)
    assert all(c["overlap_start"] is not None and chunker.word_count(words[c["overlap_start"] : c["start"]]) <= 32 for c in long[1:] if c["overlap_start"])
    # a count that falls as the text grows: ends are tried one by one
    assert "".join(c["text"].split("\n", 1)[1][-1:] for c in chunker.chunks("t", "abcdefghij" * 3, 3, lambda t: 9 if len(t) < 12 or len(t) > 20 else 1))
    with pytest.raises(chunker.TooLong):
        chunker.chunks("a very long title of many words " * 3, "text " * 50, 4)
    headed = "# Head\n" + "word " * 40
    first = chunker.chunks("t", headed, 12)[0]
    assert first["heading_path"] == ["Head"] and "word" in first["text"]  # never the heading alone
