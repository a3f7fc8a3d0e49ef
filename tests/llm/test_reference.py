"""Operators against plain implementations, and tables with everything unusual."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ballast.llm import ann, arc, bpe, decontam, langid, license_scan, ngram_join, quality, token_counts, url_rules


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def text_of(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


# neighbours


def brute(vectors, ids, query, k):
    scores = vectors.astype(float) @ vectors[query].astype(float)
    scores[query] = -np.inf
    return [(ids[i], scores[i]) for i in np.lexsort((ids, -scores))[:k]]


def found_by(df, **more):
    out = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["gaussian", "skewed", "one long", "one very long"])
def test_neighbours_of_any_lengths(spark, kind):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1200, 32))
    if kind == "skewed":
        vectors *= np.exp(rng.normal(size=(1200, 1)) * 1.5)
    elif kind != "gaussian":
        vectors[7] *= 1e4 if kind == "one long" else 1e25
    ids = np.arange(1200)
    got = found_by(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>"), shard_rows=400)
    hits = 0
    for q in range(0, 1200, 20):
        wanted = brute(vectors, ids, q, 20)
        assert len(got[q]) == 20
        assert all(s == pytest.approx(float(vectors[v] @ vectors[q]), rel=1e-9, abs=1e-9) for v, s in got[q])
        hits += len({v for v, _ in got[q]} & {v for v, _ in wanted})
    assert hits >= 0.9 * 20 * 60


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(15, 6))
    vectors[3] *= 1e18
    got = found_by(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    assert {q: len(v) for q, v in got.items()} == {0: 14}


def test_scores_are_those_of_the_double_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.13, 0.5]), (2, [0.13000000001, 0.5]), (3, [-1.0, 0.0])]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got[0] == [(2, 0.13000000001), (1, 0.13), (3, -1.0)]


def test_a_graph_reaches_every_point():
    rng = np.random.default_rng(6)
    graph = ann.Graph(rng.normal(size=(2000, 48)).astype(np.float32), degree=8, beam=16)
    assert graph._reached().all()


# language


def test_language_against_naive_bayes_by_dictionary(spark):
    r = random.Random(7)
    alphabets = {"aa": "abcdeé", "bb": "cdefgß", "cc": "efghijя"}
    rows = []
    for k in range(240):
        lang = r.choices(list(alphabets), [6, 3, 1])[0]
        rows.append((k, " ".join("".join(r.choices(alphabets[lang], k=r.randrange(1, 7))) for _ in range(r.randrange(1, 9))), lang))
    learned = [x for x in rows if crc32(str(x[0]).encode()) % 4 != 2]

    def grams(text):
        folded = " " + text.lower() + " "
        return [folded[k : k + n] for n in langid.ORDERS for k in range(len(folded) - n + 1)]

    def bucket(gram):
        value = ord(gram[0])
        for c in gram[1:]:
            value = (value * 0x100000001B3 + ord(c)) % 2**64
        return (value + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - langid.BITS)

    counts = {g: Counter() for g in alphabets}
    for _, text, lang in learned:
        counts[lang].update(map(bucket, grams(text)))
    totals, priors = {g: sum(c.values()) for g, c in counts.items()}, Counter(x[2] for x in learned)
    found = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for k, text, _ in rows:
        logs = {
            g: math.log(priors[g] / len(learned)) + sum(math.log((counts[g][b] + 0.5) / (totals[g] + 0.5 * 2**langid.BITS)) for b in map(bucket, grams(text)))
            for g in alphabets
        }
        best = max(logs, key=logs.get)
        assert found[k]["lang_pred"] == best and found[k]["held_out"] == (crc32(str(k).encode()) % 4 == 2)
        assert found[k]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


# quality


def test_ordinal_fit_against_a_plain_optimiser():
    rng = np.random.default_rng(9)
    n, buckets = 400, np.arange(100, 106)
    x = rng.random((n, 6)) < 0.5
    score = x @ np.array([1.5, -2.0, 0.7, 0.0, 0.4, -1.0]) + rng.logistic(size=n)
    grades = (score > -0.8).astype(int) + (score > 0.9)
    l2 = 1e-3

    def loss(weights, cuts):
        below = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], cuts, [np.inf]])[None, :] - (x @ weights)[:, None])))
        return -np.log(below[np.arange(n), grades + 1] - below[np.arange(n), grades]).mean() + l2 * (weights**2).sum()

    p = np.concatenate([np.zeros(6), [-0.5, np.log(1.0)]])
    of = lambda p: loss(p[:6], np.array([p[6], p[6] + np.exp(p[7])]))
    for _ in range(4000):
        slope = np.array([(of(p + d) - of(p - d)) / 2e-5 for d in np.eye(8) * 1e-5])
        p -= 0.5 * slope
    model = quality.fit([buckets[row].astype(np.int32) for row in x], grades, 3, min_rows=1, l2=l2, steps=2000, rate=0.02)
    assert loss(model.weights[buckets].astype(float), model.thresholds) == pytest.approx(of(p), abs=2e-4)
    assert model.weights[buckets] == pytest.approx(p[:6], abs=0.05) and (np.diff(model.thresholds) > 0).all()
    below = model.cumulative(np.array([0.3]))[0]
    assert (1 - below).sum() == pytest.approx((below[1] - below[0]) * 1 + (1 - below[1]) * 2)  # the expected grade


# encoding


def test_digests_are_those_of_the_public_library(spark, vocabulary):
    ranks, pattern = vocabulary
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "a", "Hello, wörld!  two  spaces\n\ttab 日本語 <|endoftext|>", text_of(300, 1), "x" * 3000, " " * 50, "".join(map(chr, range(32, 400)))]
    for row in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, pattern).collect():
        text = texts[row["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# archives


def test_archives_of_several_records_and_pieces(monkeypatch):
    records = [arc.ArcRecord(f"http://a/{k}", "1.1.1.1", "20260101000000", "text/html", k, b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + k]) * (k * 70_001 % 300_000)) for k in range(12)]
    whole = [head.encode() + block + arc.END.encode() for head, block in (arc.warc_record(r, "n") for r in records)]
    raw = b"".join(whole)
    for data in (raw, gzip.compress(raw), gzip.compress(raw[:1000]) + gzip.compress(raw[1000:]), b"".join(map(gzip.compress, whole))):
        assert [block for _, block in arc.read_warc(data)] == [r.body for r in records]
    for broken in (raw[:-500_000], gzip.compress(raw)[:-200]):
        with pytest.raises(ValueError):
            list(arc.read_warc(broken))


def test_archives_hold_both_versions_and_several_records(spark, monkeypatch):
    sizes, read_arc = [], arc.read_arc

    def counted(data):
        out = list(read_arc(data))
        sizes.append((data.split(b"\n", 2)[1][:1], len(out)))
        return out

    monkeypatch.setattr(arc, "read_arc", counted)
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * (k * 997 % 5000), None) for k in range(950)], "page_id long, url string, html string, refers_to long")
    batches = [b for b in pages.toArrow().to_batches(max_chunksize=300)]
    rows = [v for b in arc._converted.__wrapped__(batches) for v in b.column("value").to_pylist()]
    assert len(rows) == 950 and max(n for _, n in sizes) == arc.ARC_RECORDS and {v for v, _ in sizes} == {b"1", b"2"}


def test_large_pages_fill_several_files(spark, monkeypatch):
    monkeypatch.setattr(arc, "FILE_BYTES", 50_000)
    monkeypatch.setattr(arc, "ARC_BYTES", 30_000)
    bodies = {k: ("é" * 9000 if k % 3 else "same" * 2000) for k in range(40)}
    got = {r["page_id"]: r for r in arc.archived(spark.createDataFrame([(k, "http://h/", b) for k, b in bodies.items()], "page_id long, url string, html string")).collect()}
    for k, body in bodies.items():
        last = max(j for j, b in bodies.items() if b == body)
        data = body.encode()
        assert tuple(got[k]) == (k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if k == last else "revisit", None if k == last else last)


# unusual tables

EXTRA = ["node", "key", "comp", "tag", "n", "rep", "hub", "lang_pred", "score", "p_top", "shard", "kind", "class", "hash", "sha", "tokens", "item", "row", "c0", "low", "words", "grams"]
LONG = text_of(120_000, 3)
TEXTS = [None, "", " \n ", "a", text_of(60, 1), text_of(60, 1), text_of(60, 2), LONG, "\U0001f600 " * 30, "Released under the MIT License."]


def documents(spark, texts=TEXTS):
    rows = [(k // 2 * 2 if k == 5 else k, t, ("en", "de")[k % 2], *["x"] * len(EXTRA)) for k, t in enumerate(texts)] + [(None, text_of(60, 1), None, *["x"] * len(EXTRA))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in EXTRA))


def operators(spark, vocabulary):
    ratings = spark.createDataFrame([(4, 2), (6, 0), (4, 2), (None, 1), (8, None)], "doc_id long, grade int")
    items = spark.createDataFrame([(1, text_of(60, 2)), (2, None), (None, "a b c")], "item_id long, text string")
    edits = token_counts.sample_edits()
    model = lambda d: quality.train(d, ratings, 3)
    return {
        "quality": lambda d: quality.grade(d, model(d), ["doc_id"]),
        "quality stage": lambda d: quality.accepted(d, model(d)),
        "language": langid.identify,
        "language stage": lambda d: langid.accepted(d, langid.train(d)),
        "encoding": lambda d: bpe.round_trip(d, *vocabulary),
        "decontamination": lambda d: decontam.leaks(d, items),
        "decontamination stage": lambda d: decontam.clean(d, items),
        "near duplicates": ngram_join.near_duplicates,
        "near duplicates stage": ngram_join.representatives,
        "token counts": lambda d: token_counts.edited_counts(d.withColumn("edits", edits), *vocabulary),
        "archives": lambda d: arc.archived(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *EXTRA)),
        "url filter": lambda d: url_rules.judge(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), *[c for c in EXTRA if c != "tokens"]), d.select(F.col("doc_id").alias("page_id"), (F.col("lang") == "en").alias("block"), "tokens")),
        "licences": license_scan.passages,
    }


#: Rows that the unusual table gives: one for each of its rows, or what the docstrings promise.
ROWS = {"decontamination": 1, "licences": 1, "near duplicates stage": 9}


@pytest.mark.parametrize("name", [
    "quality", "quality stage", "language", "language stage", "encoding", "decontamination", "decontamination stage", "near duplicates",
    "near duplicates stage", "token counts", "archives", "url filter", "licences",
])
def test_unusual_tables(spark, vocabulary, name):
    run, docs = operators(spark, vocabulary)[name], documents(spark)
    found = run(docs)
    rows = found.collect()
    if name.endswith("stage"):
        assert found.columns == docs.columns
        assert len(rows) <= len(TEXTS) + 1
    else:
        assert len(rows) == ROWS.get(name, len(TEXTS) + 1)
    if name in ROWS:
        assert len(rows) == ROWS[name]
    assert run(docs.limit(0)).collect() == []


def test_unusual_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (20, None, "x"), (None, [1.0, 1.0], "x"), (3, [0.5, None], "x"), (4, [2.0, 1.0], "x"), (5, [], "x"), (6, [3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string").withColumn("hash", F.lit(1)).withColumn("rep", F.lit(1))
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 4, 4.0)]
    assert ann.search(df.limit(0), F.lit(True)).collect() == []


def test_pipeline_on_unusual_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text_of(60, 2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (documents(spark), documents(spark).limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_keep_what_a_plain_version_keeps(spark, tmp_path):
    r = random.Random(11)
    good, bad = [f"fine{k}" for k in range(40)], [f"awful{k}" for k in range(40)]
    item = text_of(30, 21) + ". " + text_of(8, 22) + "."
    rows, labels = [], []
    for k in range(400):
        words = [r.choice(good if k % 4 else bad) for _ in range(40)]
        text = " ".join(words)
        if k % 10 == 3:
            text = rows[-1][1] + " more"  # a near copy
        if k % 25 == 7:
            text = f"{text} {item}"
        rows.append((k, "" if k % 50 == 9 else text, "en"))
        labels.append((k, int("awful" not in text), 0))
    spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {k: (k, t, g) for k, t, g in rows if t}  # the language stage: no letters, no language
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language"](spark, docs, str(tmp_path))
    assert {x["doc_id"] for x in docs.collect()} == set(kept)
    docs = stages["quality"](spark, docs, str(tmp_path))
    kept = {k: x for k, x in kept.items() if "awful" not in x[1]}
    assert {x["doc_id"] for x in docs.collect()} == set(kept)
    docs = stages["near_duplicates"](spark, docs, str(tmp_path))
    sets = {k: s for k, (_, s) in zip(sorted(kept), ngram_join.shingle_sets([kept[k][1] for k in sorted(kept)]))}
    group = {}
    for k in sorted(sets):
        linked = {group[j] for j in group if ngram_join.similar(sets[j], sets[k])}
        group[k] = min(linked | {k})
        group |= {j: group[k] for j in group if group[j] in linked}
    kept = {k: x for k, x in kept.items() if group[k] == k}
    assert {x["doc_id"] for x in docs.collect()} == set(kept) and len(kept) < len(sets)
    docs = stages["decontamination"](spark, docs, str(tmp_path))
    kept = {k: x for k, x in kept.items() if item not in x[1]}
    assert {x["doc_id"] for x in docs.collect()} == set(kept)
    out = stages["encoding"](spark, docs, str(tmp_path)).collect()
    assert {x["doc_id"]: x["decoded_sha256"] for x in out} == {k: hashlib.sha256(x[1].encode()).hexdigest() for k, x in kept.items()}
