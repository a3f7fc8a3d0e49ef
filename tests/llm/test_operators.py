"""Operators on small made-up tables: brute force, exact round trips, nulls, ties, repeated rows, empty tables."""

import hashlib
import os
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm import ann, arc, bpe, decontam, langid, license_scan, ngram_join, quality, token_counts, url_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


# neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 24)).astype(np.float32)
    vectors[700:900] = vectors[5]  # one vector many times
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(9000, None, 0), (9020, [0.0] * 24, 0), (9040, [float("nan")] * 24, 0), (9060, [None] * 24, 0), (None, [1.0] * 24, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, shard_rows=600).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = vectors[q].astype(float) @ vectors.T.astype(float)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_few_and_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# language and quality


def test_language(spark):
    rng = random.Random(1)
    make = {"xx": "abcde", "yy": "vwxyz"}
    langs = [rng.choice(["xx", "yy"]) for _ in range(300)]
    texts = [" ".join("".join(rng.choices(make[g], k=5)) for _ in range(20)) for g in langs]
    texts[:3] = [None, "", "12 34 !"]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, texts, langs)).collect()}
    assert len(got) == 300
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(3))
    assert sum(got[i]["lang_pred"] == langs[i] for i in range(3, 300)) >= 295
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))


def test_language_without_anything_to_learn(spark):
    docs = documents(spark, ["abc", None], [None, None])
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()] == [("und", 0.0)] * 2
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_long_text_in_slices():
    text = "abc déf " * 200_000
    n = Counter()
    for rows, buckets in langid._features([text, "x"]):
        n.update(rows.tolist())
    assert n[0] > len(text) * 2
    assert set(n) == {0, 1}


def test_quality_keeps_clean_and_drops_marked(spark):
    rng = random.Random(2)
    texts, rows = [], []
    for i in range(600):
        w = words(30, i)
        grade = rng.choice([0, 1, 2, 2])
        if grade == 0:
            w.insert(5, rng.choice(["awful", "horrid"]))
        if grade == 1:
            w = [x + " ###" for x in w]
        texts.append(" ".join(w))
        rows.append((i, grade))
    docs = documents(spark, [*texts, None, ""])
    model = quality.train(docs, spark.createDataFrame(rows, "doc_id long, grade int"), 3)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r["doc_id"]: r for r in quality.grade(docs, model, ["doc_id"]).collect()}
    assert len(got) == 602
    assert np.mean([(got[i]["p_top"] >= 0.5) == (g == 2) for i, g in rows]) > 0.97
    assert got[600]["p_top"] == got[601]["p_top"]
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns


def test_quality_without_ratings(spark):
    docs = documents(spark, ["a b", None])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert quality.grade(docs, model, ["doc_id"]).count() == 2


# byte-level BPE


def test_bpe_equals_tiktoken(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary
    own = bpe.Encoder(bpe.Vocabulary(ranks), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pieces = [" ", "  ", "\n", "a", "the", "é", "'s", "1", ".", "\x1c", "\xa0", "日本", "😀", "\t"]
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randrange(60)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    for text in ("a" * 5000, "ab" * 3000, " " * 4000, "<|endoftext|>"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_bpe_long_text_in_parts(vocabulary):
    own = bpe.Encoder(bpe.Vocabulary(vocabulary[0]), vocabulary[1])
    text = "some words  and\nmore " * 70_000
    whole = own.encode(text)
    assert own.decode(whole) == text.encode()
    limit, bpe.LONG = bpe.LONG, 1 << 30
    try:
        assert own.encode(text) == whole
    finally:
        bpe.LONG = limit


def test_bpe_query(spark, vocabulary):
    texts = ["Hello wörld", None, "", "Hello wörld"]
    got = bpe.round_trip(documents(spark, texts), *vocabulary).orderBy("doc_id").collect()
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert got[1]["n_tokens"] == 0
    assert got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    coded = bpe.encode(documents(spark, texts), *vocabulary)
    back = bpe.decode(coded, *vocabulary).orderBy("doc_id").collect()
    assert [bytes(r["bytes"]).decode() for r in back] == [t or "" for t in texts]
    assert bpe.round_trip(documents(spark, texts).limit(0), *vocabulary).count() == 0


def test_token_tree_against_new_encoding(vocabulary):
    own = bpe.Encoder(bpe.Vocabulary(vocabulary[0]), vocabulary[1])
    rng = random.Random(5)
    pieces = [" ", "a", "b", ".", "1", "\n", "é", "'", "re", "'s", "  "]
    for _ in range(400):
        text = "".join(rng.choices(pieces, k=rng.randrange(400)))
        tree = token_counts.TokenTree(own, text)
        for _ in range(5):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 3, 50, 10_000]))
            new = "".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 800])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text
            assert tree.n_tokens == len(own.encode(text))


def test_edited_counts(spark, vocabulary):
    own = bpe.Encoder(bpe.Vocabulary(vocabulary[0]), vocabulary[1])
    texts = ["one two three four " * 50, None, "", "x"]
    docs = documents(spark, texts).select("doc_id", "text", token_counts.sample_edits().alias("edits"))
    plain = {r["doc_id"]: (r["text"] or "", r["edits"]) for r in docs.collect()}
    for r in token_counts.edited_counts(docs, *vocabulary).collect():
        text, edits = plain[r["doc_id"]]
        assert r["n_tokens"] == len(own.encode(text))
        for e in edits:
            text = text[: e["start"]] + e["new"] + text[e["end"] :] if e["start"] <= len(text) else text + e["new"]
        assert r["n_tokens_edited"] == len(own.encode(text))


# archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    start = arc.arc_start("a.arc", version)
    body = b"HTTP/1.1 200 OK\r\n\r\nline\n\nURL 1 2 3\n"
    data = start + arc.arc_record("http://x.org/a b", body, version, "a.arc", len(start), "20040102030405") + arc.arc_record("dns:x.org", b"1.2.3.4", version, mime="text/dns")
    got = list(arc.read_warc(arc.convert(data, "a.arc")))
    assert [f["warc-type"] for f, _ in got] == ["response", "resource"]
    assert got[0][1] == body
    assert got[0][0]["warc-date"] == "2004-01-02T03:04:05Z"
    assert got[0][0]["warc-payload-digest"] == "sha1:" + arc.digest(b"line\n\nURL 1 2 3\n")
    assert got[0][0]["warc-record-id"] == next(arc.read_warc(arc.convert(data, "a.arc")))[0]["warc-record-id"]
    with pytest.raises(ValueError, match="declared length"):
        list(arc.read_arc(data[:-3]))


def test_archives(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c", "WARC/1.1\r\n\r\n\r\n\r\nother\n\n"), (4, "http://d e", None), (5, "http://f", ""), (None, "http://g", "same"), (2, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in arc.archived(df).collect()), key=repr)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        kept = {"same": 2, "": 5}.get(html or "", page)
        expected.append((page, len(data), arc.digest(data), "response" if page == kept else "revisit", None if page == kept else kept))
    assert got == sorted(expected, key=repr)
    assert arc.archived(df.limit(0)).count() == 0


# decontamination


def test_leaks(spark):
    items = [(i, " ".join(words(25, 100 + i)) + ". " + " ".join(words(8, 900 + i)) + ".") for i in range(30)]
    texts = [" ".join(words(300, i)) for i in range(40)]
    planted = {(3, 7), (9, 7), (12, 20), (39, 0)}
    for doc, item in planted:
        w = texts[doc].split()
        texts[doc] = " ".join([*w[:130], items[item][1].upper(), *w[130:]])
    texts += [None, ""]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    docs = documents(spark, texts)
    found = decontam.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == set(range(42)) - {3, 9, 12, 39}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), bench).count() == 0


def test_wand_finds_what_brute_force_finds():
    items = [(i, " ".join(words(20, i, 60))) for i in range(50)]
    for index in decontam.Indexes(items).indexes:
        for seed in range(60):
            terms = sorted({index.terms[w] for w in words(64, 500 + seed, 60) if w in index.terms})
            brute = {}
            for t in terms:
                for item, value in zip(index.postings[t], index.impacts[t]):
                    brute[item] = brute.get(item, 0) + value
            got = dict(index.search(terms, list(range(index.n_blocks)), 0.5))
            assert set(got) == {k for k, v in brute.items() if v >= 0.5 - 1e-9}


# Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "  \t", "One two", "one TWO", "one two three four five", "one two three four five six"]
    for n in (6, 8, 9, 12, 20, 30, 45, 60, 90, 150, 250, 400, 600):
        base = words(n, n, 5000)
        for k in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, n // 30) + 1)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            cut = rng.choice([0, 0, 1, n // 10, n // 5])
            texts.append(" ".join(w[: len(w) - cut] if k % 2 else w[cut:]))
    shared = words(60, 77)
    texts += [" ".join(words(40, 1000 + k, 5000) + shared) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    kept = {r["doc_id"] for r in ngram_join.representatives(documents(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts)) if c == i}


def test_jaccard_edge_tables(spark):
    docs = documents(spark, ["a b c d e f", "x"])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (None, 2, 5), (5, 2, 5), (None, 2, None)], key=repr)
    assert ngram_join.representatives(rows).filter("doc_id = 5").count() == 1


def test_schemes_suffice():
    for n in range(5, 3000):
        own = ngram_join.native_scheme(n)
        assert own.low <= n <= own.high
        assert own.m * own.v >= 2 * n // 9 + 1


# URLs and licences


def test_url_parts_and_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/1?q#x", "https://www.example.com/en/2", "http://b.net/fr/", "http://net/es/?a", "http://xexample.org?x=/en/", "x://h#f", "http://sub.www.example.com/en/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, block boolean")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, none).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("b.net", "/fr/", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"),
        ("xexample.org", "", None, "allow"), ("h", "", None, "allow"), ("sub.www.example.com", "/en/z", "www.example.com/en/", "allow"),
    ]


def test_url_rules_are_mined(spark):
    rows = [(i, f"https://site{i % 7}.org/{'bad' if i % 3 == 0 else 'good'}/{i}") for i in range(300)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)] + [(5, None)], "page_id long, block boolean")
    got = url_rules.judge(pages, labels, 0.01, 0.6).collect()
    assert len(got) == 301
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_licenses(spark):
    texts = [None, "", "words\nLicensed under  the APACHE license version 2.0\nmore", "released under the MIT License.", "the license of the world", "Licensed under CC BY-NC 4.0. " + " ".join(words(50, 1)), "\n".join(["Released under the MIT License."] * 3)]
    got = {(r["doc_id"], r["license"]): r["n_hits"] for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got == {(2, "Apache-2.0"): 1, (3, "MIT"): 1, (6, "MIT"): 3}


def test_license_anchors_lose_nothing():
    grams = [list(dict.fromkeys(map(" ".join, zip(w, w[1:])))) for w in (license_scan._plain(t) for _, t in license_scan.TEMPLATES)]
    anchors = license_scan.anchors(grams, 0.8)
    for (_, text), g in zip(license_scan.TEMPLATES, grams):
        w = license_scan._plain(text)
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                part = set(map(" ".join, zip(w[a:b], w[a + 1 : b])))
                if 2 * len(part & set(g)) >= 0.8 * (len(part) + len(g)):
                    assert any(x in " ".join(w[a:b]) for x in anchors)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = got.collect()
    assert 0 < len(rows) < len(texts)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
