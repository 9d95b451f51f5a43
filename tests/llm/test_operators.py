"""The corpus operators against brute force, round trips and held-out rows."""

import re
from collections import Counter, defaultdict
from hashlib import sha1, sha256

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marginalia.llm import near_dup, op1_pii, op2_quality, op3_shard, op4_language, op6_warc, op7_mix, op8_toxicity, op9_rules, op10_decontaminate

ODD = [None, "", " \n\t", "x", "one two", "é" * 50, "a b c " * 400, "word " * 3000, "same text here now", "same text here now", "1.2.3.4 a@b.co +1 (988) 555-2485", "@@@@ .... ++++ 12 34", "\x00 \U0001f600 z"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k if k != 3 else None, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s1", 7, "clash", 1.0) for k, t in enumerate(ODD)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, fp bigint, shard string, score double")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op1

KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


HARD = ["a@b.c_x@d.com y@z@w.org", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "\U0001f600 mail joe@x.io +1 (988) 555-2485.", "1 " * 3000 + "+" * 50 + " " + "a" * 9000 + "@b", "q@w.e " * 700, "a@b." + "c." * 3000 + "d"]


def test_pii_base_equals_brute_force(spark, docs, odd):
    model = op1_pii.fit(spark)
    hard = spark.createDataFrame([(9_000_000 + k, t) for k, t in enumerate(HARD)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(hard).unionByName(odd.select("doc_id", "text"))
    got = op1_pii.spans(every, model).select("text", op1_pii.joined(F.col("base")).alias("b"), op1_pii.joined(F.col("every")).alias("e")).collect()
    assert len(got) == every.count()
    for r in got:
        assert r["b"] == base_spans(r["text"])
        assert set(filter(None, r["b"].split(","))) <= set(r["e"].split(","))
    clean = [r for r in got if not r["b"]]
    assert sum(bool(r["e"]) for r in clean) <= 1


def test_pii_adds_and_redacts(spark):
    model = op1_pii.fit(spark)
    df = spark.createDataFrame([(1, "contact joe (at) example (dot) com or tel 988 555 2485, order 12345678"), (2, "mail a@b.co")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in op1_pii.redacted(op1_pii.spans(df, model)).collect()}
    assert out[2] == "mail [EMAIL]" and "[EMAIL]" in out[1] and "[PHONE]" in out[1] and "12345678" in out[1]


def test_pii_candidates_never_overlap(spark):
    model = op1_pii.fit(spark)
    assert all(p >= op1_pii.PRECISION for p in model.precision) and len(model.thresholds) == 4
    texts = {1: "card 4111.1111.1111.1 now", 2: "4111 1111 1111 1112", 3: "call 555 123 4567 or tel 988 555 2485 ok", 4: "reach joe (at) example (dot) com, phone 988-555-2485", 5: "order 4111 1111 1111 1112 shipped", 6: "call 988 555 2485 " * 300}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["every"]] for r in op1_pii.spans(df, model).collect()}
    for every in got.values():
        assert all(a[2] <= b[0] for a, b in zip(every, every[1:]))
    assert len(got[1]) <= 1 and got[2] == [] and got[5] == []
    assert [s[1] for s in got[4]] == [0, 3] and len(got[3]) == 2 and len(got[6]) == 300


# op2, op4, op8


def test_models_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op2_quality.scored(d, op2_quality.fit(d, labels), 0.3).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    got = op8_toxicity.scored(d, op8_toxicity.fit(d, labels)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.85 * len(got)
    langs = op4_language.identify(d, op4_language.fit(d)).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in langs) >= 0.97 * len(langs)


def test_factorisation_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    m = op2_quality.Machine(0.1)
    m.v = rng.normal(0, 0.1, m.v.shape)
    m.w = rng.normal(0, 0.1, m.w.shape)
    at, x = op2_quality.features(b"some words here, some words there! ***")
    pairs = sum(m.v[a] @ m.v[b] * xa * xb for k, (a, xa) in enumerate(zip(at, x)) for b, xb in list(zip(at, x))[k + 1 :])
    z = m.b + m.w[at] @ x + pairs
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-z))) < 1e-9


def test_block_max_search_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    vocabulary = {f"t{k}": float(rng.uniform(1, 5)) for k in range(40)}
    rows = [({f"t{k}": int(rng.integers(1, 4)) for k in rng.choice(40, rng.integers(0, 6), replace=False)}, int(rng.integers(0, 2))) for _ in range(700)]
    index = op8_toxicity.Index(vocabulary, rows, 0.3)
    dense = np.zeros((len(index.y), 40))
    for d, (ids, w) in enumerate(zip(index.ids, index.weights)):
        dense[ids, d] = w
    for counts, _ in rows[:80]:
        v = index.vector(counts)
        if v is None:
            continue
        q = np.zeros(40)
        q[v[0]] = v[1]
        want = np.sort(dense @ q)[::-1][:15]
        assert np.allclose(index.nearest(v, 15)[1], want[want > 0], atol=1e-9)


def test_repeated_ids_fit_the_same_machine(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))).unionByName(docs)
    a, b = (op2_quality.fit(x, labels, bound=40) for x in (twice.repartition(3), twice.repartition(7, "source")))
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.b == b.b


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 1), (6, 1, 1), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        for got in (op2_quality.scored(odd, op2_quality.fit(odd, labels), 0.3), op8_toxicity.scored(odd, op8_toxicity.fit(odd, labels))):
            rows = got.collect()
            assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in op4_language.identify(odd, op4_language.fit(odd)).collect()} == {"und", "en"}
    assert {r["lang_pred"] for r in op4_language.identify(odd, op4_language.fit(odd.where("lang is null"))).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 4, 6, 12, 30):
        m = op4_language.codewords(n)
        assert len({tuple(r) for r in m.tolist()}) == n and all(abs(c.sum()) < n for c in m.T)


def test_decoding_equals_brute_force():
    """Language, score and ambiguity against sums written out bit by bit, for few and for many languages."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    for n in (2, 3, 5, 9):
        centres = np.abs(rng.normal(0, 1, (n, op4_language.BUCKETS)))
        labels = np.repeat(np.arange(n), 24)
        x = (centres[labels] + 0.4 * np.abs(rng.normal(0, 1, (len(labels), op4_language.BUCKETS)))).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        model = op4_language.Decoder([f"l{k}" for k in range(n)], x, labels)
        right = 0
        for row, label in zip(x[::5], labels[::5]):
            margins = [sum(float(a) * float(b) for a, b in zip(row, model.w[:-1, k])) + float(model.w[-1, k]) for k in range(model.w.shape[1])]
            loss = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(model.bit_weights, word, margins)) for word in model.words]
            p = [math.exp(2 * math.sqrt(len(margins)) * (min(loss) - v)) for v in loss]
            p = [v / sum(p) for v in p]
            first, second = sorted(range(n), key=lambda k: -p[k])[:2]
            lang, score, unsure = model.decode(row)
            assert lang == f"l{first}" and abs(score - p[first]) < 1e-3
            assert unsure == (p[first] - p[second] < op4_language.MARGIN) or abs(p[first] - p[second] - op4_language.MARGIN) < 1e-3
            right += first == label
        assert right >= 0.95 * len(labels[::5])


def test_many_languages_stay_bounded(spark, monkeypatch):
    rows = [(k, f"lang{k % 40}", " ".join(chr(97 + (k % 40 * 7 + j) % 26) * 3 for j in range(6)) + chr(0x400 + k % 40) * 20) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    monkeypatch.setattr(op4_language, "ROWS", 300)
    monkeypatch.setattr(op4_language, "LANGS", 30)
    model = op4_language.fit(df)
    assert 20 <= len(model.langs) <= 30
    got = op4_language.identify(df, model).collect()
    known = [r for r in got if rows[r["doc_id"]][1] in model.langs]
    assert sum(r["lang_pred"] == rows[r["doc_id"]][1] for r in known) >= 0.95 * len(known)


def test_empty_documents(spark, tmp_path):
    """Every query over documents gives no rows for an empty table."""
    from marginalia.llm import entry

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, f in entry.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_scratch_tables_go(spark, docs):
    import os

    from marginalia.session import shared_dir

    top = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top))
    assert near_dup.near_duplicates(docs).count() == docs.count() and near_dup.deduplicate(docs).count() < docs.count()
    assert len(set(os.listdir(top)) - before) == 2


# op3, op7, op9


def test_shards_are_even_and_stable():
    table = op3_shard.fill()
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = op3_shard.fill(op3_shard.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(op3_shard.SHARDS) - 1)
    assert moved < 0.15 * len(table)
    with pytest.raises(ValueError):
        op3_shard.fill(slots=100)


def test_placement_of_odd_rows(spark, odd):
    got = op3_shard.place(odd)
    assert got.count() == odd.count() and got.columns.count("shard") == 1
    assert op3_shard.place(odd.limit(0)).count() == 0


def water_fill(sizes, weights, total):
    """Targets by sharing, stopping and sharing again."""
    goal, stopped = {k: 0.0 for k in sizes}, set()
    while True:
        rest = total - sum(2 * sizes[k] for k in stopped)
        w = sum(weights[k] for k in sizes if k not in stopped)
        if not w:
            break
        share = {k: rest * weights[k] / w for k in sizes if k not in stopped}
        over = {k for k, v in share.items() if v > 2 * sizes[k]}
        if not over:
            goal.update(share)
            break
        stopped |= over
    return goal | {k: 2.0 * sizes[k] for k in stopped}


@pytest.mark.parametrize("sizes", [[5, 100, 50, 7], [1000, 1, 1, 1], [10, 10, 10], [0, 5], [3]])
def test_mix_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in op7_mix.targets(df).collect()}
    want = water_fill(dict(zip(names, sizes)), {n: (3.0, 1.0, 2.0)[k % 3] for k, n in enumerate(names)}, 1.5 * sum(sizes))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_of_odd_rows(spark, odd):
    got = op7_mix.mixed(odd).collect()
    assert len(got) == odd.count()
    by_id = {(r["doc_id"], r["source"]): r["size"] for r in got}
    assert all(r["copies"] <= 2 for r in got) and by_id[(6, None)] == 1200
    assert op7_mix.mix(odd).columns == odd.columns and op7_mix.mix(odd.limit(0)).count() == 0
    assert sorted(map(str, op7_mix.mix(odd).collect())) == sorted(map(str, op7_mix.mix(odd).collect()))


def test_rules_on_odd_rows(spark, odd):
    got = op9_rules.apply_rules(odd).collect()
    assert len(got) == odd.count()
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r["doc_id"]].add(r["text"])
    for r in got:
        (text,) = texts[r["doc_id"]]
        ws = words(text)
        seen = Counter(zip(ws, ws[1:], ws[2:]))
        inside = {i + d for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
    assert op9_rules.apply_rules(odd.limit(0)).count() == 0


def test_sources_set_their_own_fences(spark):
    """A text with as many symbols as its own source is used to stays; the same text goes in a source that has none."""
    plain = " ".join(f"w{k}ord{k % 7}x" for k in range(120))
    signs = lambda n: plain + " " + " ".join(f"#{k}" for k in range(n))
    rows = [(k, plain, "en", "prose") for k in range(400)] + [(1000 + k, signs(60 + k), "en", "code") for k in range(200)]
    rows += [(5000, signs(150), "en", "prose"), (5001, signs(150), "en", "code"), (5002, plain + " ".join("#" * 20 + str(k) for k in range(200)), "en", "code"), (5003, plain + "\n" + "\n".join(["one line"] * 2), "en", "prose"), (5004, signs(150), "en", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in op9_rules.apply_rules(df).collect()}
    assert not got[5000]["kept"] and got[5000]["broken"] == "symbol_ratio" and got[5001]["kept"] and not got[5002]["kept"] and got[5003]["kept"]
    assert got[5000]["max_symbol_ratio"] == 0 < 0.1 < got[5001]["max_symbol_ratio"] < got[5002]["symbol_ratio"]
    assert got[5004]["kept"] and got[5004]["max_symbol_ratio"] > 0  # one document leans on its language, part of which has symbols


# op5


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = words(low)
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    ids = list(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs):
    extra = [(10_000_000 + k, t) for k, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in df.collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()}
    roots = brute_components(fps, 3)
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in fps.items()}


@pytest.mark.parametrize(("segments", "hot"), [(2, 4096), (4, 8), (3, 5)])
def test_links_of_dense_groups(spark, monkeypatch, segments, hot):
    import random

    monkeypatch.setattr(near_dup, "TABLE_ROWS", hot)
    rnd = random.Random(segments)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {b for b in base for _ in range(40) for b in [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(5)))]} | {rnd.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.components(df, 3, segments).collect()}
    assert got == brute_components({k: f & (1 << 64) - 1 for k, f in enumerate(signed)}, 3)


def test_chains_connect(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in near_dup.connected(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


def test_dedup_keeps_one_of_each_group(spark, odd):
    import random

    rnd = random.Random(2)
    w = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [[w() for _ in range(200)] for _ in range(20)]
    rows = []
    for g, ws in enumerate(base):
        rows.append((10 * g, " ".join(ws)))
        rows.append((10 * g + 1, " ".join(ws)))
        near = list(ws)
        near[rnd.randrange(200)] = w()
        rows.append((10 * g + 2, " ".join(near)))
        far = ws[:100] + [w() for _ in range(100)]
        rows.append((10 * g + 3, " ".join(far)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, _gone string")
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x for g in range(20) for x in (10 * g, 10 * g + 3))
    twice = near_dup.deduplicate(odd)
    texts = [r["text"] for r in twice.collect()]
    assert texts.count("same text here now") == 1 and texts.count("é" * 50) == 1 and twice.columns == odd.columns
    assert near_dup.deduplicate(odd.limit(0)).count() == 0


# op6


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(1, "http://A.example.com/x?b=1#f", big), (2, "http://a.example.com/y", big), (2, "http://a.example.com/y", big), (3, None, None), (4, "http://b.org", ""), (5, "http://b.org/\r\nX: y", "small"), (6, "https://www.b.org:443/z", "small"), (None, "http://c", big + "1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    top = f"file://{tmp_path}"
    op6_warc.write_archives(pages, f"{top}/a", file_bytes=3000)
    index = op6_warc.CaptureIndex.build(spark, f"{top}/a", f"{top}/i", lines=2)
    got = sorted(map(tuple, op6_warc.read_back(spark, f"{top}/a", index).collect()), key=str)
    digest = lambda t: sha1((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), digest(h), "revisit" if p == 1 else "response", 2 if p == 1 else None) for p, _, h in rows]
    assert got == sorted(want, key=str)
    again = lambda: sorted(map(tuple, op6_warc.read_back(spark, f"{top}/a", op6_warc.CaptureIndex(spark, f"{top}/i"), pages=pages).collect()), key=str)
    assert again() == got  # every URL looked up
    for name, value in (("_reachable", lambda uri: False), ("BROADCAST_ROWS", 1)):  # files read by Spark, then keys joined
        monkeypatch.setattr(op6_warc, name, value)
        assert again() == got
    monkeypatch.undo()
    found = index.lookup("http://a.example.com:80/x?b=1")
    assert [h["WARC-Type"] for h, _ in found] == ["revisit"] and index.lookup("http://nowhere") == []
    assert index.lookup("http://a.example.com/y")[0][1] == big.encode()
    assert op6_warc.url_key("https://www.Sub.example.com:8080/P") == "com,example,sub:8080)/p"
    op6_warc.write_archives(pages.limit(0), f"{top}/none")
    assert op6_warc.captures(spark, f"{top}/none").count() == 0
    none = op6_warc.CaptureIndex.build(spark, f"{top}/none", f"{top}/no_index")
    assert none.lookup("http://b.org") == [] and op6_warc.read_back(spark, f"{top}/none", none, pages=pages).count() == 0
    records = [h for f in (tmp_path / "a").rglob("part-*") for _, _, h, _ in op6_warc.records(f.read_bytes())]
    names = {h["WARC-Record-ID"] for h in records}
    assert len(records) == len(rows) and all(h["WARC-Refers-To"] in names for h in records if h["WARC-Type"] == "revisit")
    longest = max(len(r) for r in map(str, (b for _, _, b in rows))) * 2 + 1000
    assert all(f.stat().st_size <= 3000 + longest for f in (tmp_path / "a").rglob("part-*"))


def test_revisits_are_checked(spark, tmp_path):
    """A revisit whose response says something else than it states reads back without size and digest."""
    big = "<p>" + "z" * 2000
    pages = spark.createDataFrame([(1, "http://a.org/1", big), (2, "http://a.org/2", big)], "page_id bigint, url string, html string").coalesce(1)
    op6_warc.write_archives(pages, f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").rglob("part-*")
    file.write_bytes(file.read_bytes().replace(b"z" * 2000, b"y" * 2000))
    for crc in (tmp_path / "a").rglob(".part-*.crc"):
        crc.unlink()
    index = op6_warc.CaptureIndex.build(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/i")
    got = {r["page_id"]: r for r in op6_warc.read_back(spark, f"file://{tmp_path}/a", index).collect()}
    assert got[2]["payload_bytes"] == 2003 and got[1]["payload_bytes"] is None and got[1]["payload_digest"] is None

# op10


def edit_distance_within(passage, text):
    """Least edits of passage against any part of text."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_matches_equal_brute_force():
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["an", "er", "on", "ti", "th"]) for _ in range(rnd.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 2, 8, 14])))) for k in range(12)]
    passages = op10_decontaminate.Passages(items)
    for _ in range(40):
        _, p = rnd.choice(items)
        s = list(p)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(2)] = rnd.choice(["", "q", "e"])
        text = " ".join([word() for _ in range(10)] + ["".join(s)] + [word() for _ in range(10)])
        got = {g[1]: g[4] for g in passages.find([text])}
        for i, q in items:
            q, t = op10_decontaminate.normal(q), op10_decontaminate.normal(text)
            k = min(int(0.1 * len(q)), (len(q) - 8) // 8) if len(q) >= 8 else 0
            best = edit_distance_within(q, t)
            assert (i in got) == (best <= k), (q, t, best, k)
            if i in got:
                assert got[i] == best


def test_common_qgrams_need_bounded_memory(monkeypatch):
    """Halving texts and passages and counting in windows give what one count gives, on passages that share most q-grams."""
    import random

    rnd = random.Random(9)
    line = "the same few words again and again "
    items = [(k, line * rnd.randint(2, 6) + rnd.choice("xyz") * 9 + line * rnd.randint(0, 2)) for k in range(14)] + [(14, "ab" * 300), (15, "one two")]
    texts = [line * rnd.randint(0, 8) + rnd.choice(items)[1] + line * rnd.randint(0, 3) for _ in range(25)] + ["ab" * 900, "a" * 500, "one two three"]
    texts += ["".join(c for c in t if rnd.random() > 0.03) for t in texts]
    key = lambda found: sorted(g[:2] + g[4:] for g in found)
    want = key(op10_decontaminate.Passages(items).find(texts))
    assert len(want) > 60
    for limit in (40, 700, 5000):
        monkeypatch.setattr(op10_decontaminate, "EXPANSION", limit)
        assert key(op10_decontaminate.Passages(items).find(texts)) == want


def test_large_block_of_skewed_words_stays_small():
    import random
    import tracemalloc

    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 5))) for _ in range(60)]
    text = lambda n: " ".join(words[int(60 * rnd.random() ** 3)] for _ in range(n))
    passages = op10_decontaminate.Passages([(k, text(60)) for k in range(1500)])
    passages.table  # noqa: B018
    tracemalloc.start()
    passages.find([text(12_000)])
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_decontamination(spark, docs, sf, odd):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {r["doc_id"] for r in docs.join(items.select(F.col("text").alias("p")), F.contains(F.col("text"), F.col("p"))).select("doc_id").collect()}
    found = op10_decontaminate.matches(docs, items)
    assert want <= {r["doc_id"] for r in found.collect()}
    small = {tuple(r) for r in op10_decontaminate.matches(docs, items, block=500).collect()}
    assert small == {tuple(r) for r in found.collect()}
    kept = op10_decontaminate.decontaminate(docs, items)
    assert not want & {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns
    odd_items = spark.createDataFrame([(1, None), (2, " "), (3, "one two")], "item_id smallint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in op10_decontaminate.matches(odd, odd_items).collect()] == [(4, 3)]
    assert op10_decontaminate.decontaminate(odd, odd_items.limit(0)).count() == odd.count()
    assert op10_decontaminate.matches(odd.limit(0), odd_items).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0.5 * sizes[0] and sizes[4] == sizes[5]
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_base_hash(spark, sf):
    from marginalia.llm import entry

    r = entry.QUERIES["op1_pii"](spark, sf).where("n_email + n_ip + n_card + n_phone = 0").first()
    assert r["base_sha256"] == sha256(b"").hexdigest()
