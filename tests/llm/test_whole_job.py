"""What the operators once left out."""

import random
import textwrap
from itertools import combinations
from pathlib import Path

import pytest

from ballast.llm import common, decontam, license_scan, ngram_join, url_rules

DOCS = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# licences


def test_licence_passages_cross_lines_and_stand_in_longer_ones(spark):
    notices = {name: max((t for n, t in license_scan.NOTICES if n == name), key=len) for name in ("GPL-3.0", "MIT", "Apache-2.0")}
    grant = next(t for _, t in license_scan.NOTICES if t.endswith("subject to the following conditions:"))
    filler = " ".join(f"w{k}" for k in range(40))
    texts = [
        textwrap.fill(license_scan.TEMPLATES[8][1], 70),  # the GPL notice in four lines
        "\n".join("# " + line for line in textwrap.wrap(grant, 60)),
        f"{filler} Licensed under CC BY-NC 4.0. {filler}",
        f"{filler}, {grant} {filler}",
        "\n".join(["Released under the MIT License."] * 3),
        " ".join(["Released under the MIT License."] * 3),
        *(textwrap.fill(t, 50) for t in notices.values()),
        f"{filler}\nthe license of the software, and the terms of the license\n{filler}",
        None,
        "",
        "license",
    ]
    got = {(r["doc_id"], r["license"]): (r["n_hits"], r["dice"]) for r in license_scan.passages(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {k: (n, pytest.approx(1)) for k, n in {
        (0, "GPL-3.0"): 1, (1, "MIT"): 1, (2, "CC-BY-NC-4.0"): 1, (3, "MIT"): 1, (4, "MIT"): 3, (5, "MIT"): 3, (6, "GPL-3.0"): 1, (7, "MIT"): 1, (8, "Apache-2.0"): 1,
    }.items()}


def test_licence_passages_against_brute_force(spark):
    name, notice = license_scan.TEMPLATES[0]
    text = f"some words licensed under the new apache\nlicense version 2.0 and {notice} the end of the apache license"
    words, own = license_scan._plain(text), license_scan._plain(notice)
    grams, wanted = list(zip(words, words[1:])), set(zip(own, own[1:]))
    dice = [2 * len(set(grams[a:b]) & wanted) / (len(set(grams[a:b])) + len(wanted)) for a in range(len(grams)) for b in range(a + 1, len(grams) + 1)]
    row = license_scan.passages(frame(spark, [(1, text)]), [(name, notice)]).first()
    assert (row["n_hits"], row["dice"]) == (2, pytest.approx(max(dice)))


# rows of the pipeline


def words(n, seed):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_representatives_are_rows(spark):
    a, b, c = (words(60, seed) for seed in (1, 2, 3))
    docs = frame(spark, [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, c), (4, c), (4, a), (5, ""), (5, None)])
    assert rows_of(ngram_join.representatives(docs)) == sorted([(1, a), (2, b), (4, c), (5, ""), (5, None)], key=repr)


def test_rows_without_an_id_are_filtered(spark):
    a, b = words(60, 1), words(60, 2)
    docs = frame(spark, [(None, a), (7, a), (None, b), (None, b), (None, b + " end"), (None, None)])
    kept = rows_of(ngram_join.representatives(docs))
    assert len(kept) == 3 and {r for r in kept if r[1] != b and r[1] != b + " end"} == {(7, a), (None, None)}
    item = words(30, 9) + ". " + words(8, 11) + "."
    docs = frame(spark, [(None, f"{a} {item} {b}"), (None, a), (3, b), (3, f"{b} {item}"), (None, None)])
    assert rows_of(decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))) == sorted([(None, a), (3, b), (None, None)], key=repr)


# BM25


def test_scores_do_not_depend_on_classes_or_shards(spark, monkeypatch):
    items = [(k, words(12 + 3 * k, k) + ". common words here.") for k in range(12)]
    known = decontam.Statistics.of([t for _, t in items])
    bags = [decontam.words_of(t) for _, t in items]
    assert (known.n, known.mean) == (12, sum(map(len, bags)) / 12)
    assert known.holding["common"] == 12
    impacts = {}
    for part in (items, items[:5], items[5:]):
        for index in decontam.Indexes(part, known).indexes:
            for word, term in index.terms.items():
                for at, value in zip(index.postings[term], index.impacts[term]):
                    assert impacts.setdefault((word, index.ids[at]), value) == pytest.approx(value)
    docs = frame(spark, [(k, " ".join(t.split()[: 3 * len(t.split()) // 4]) + " " + words(20, 50 + k)) for k, t in items])
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(docs, table, 0.2, 0.0).collect()}
    monkeypatch.setattr(decontam, "SHARD", 4)
    parts = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(docs, table, 0.2, 0.0).collect()}
    assert whole and parts.keys() == whole.keys()
    assert all(parts[k] == pytest.approx(whole[k]) for k in whole)


# large groups of near copies


def family(n_first, n_second, n_passage):
    """Near copies of one text and of another like it, most of them not similar to each other, and texts that share a passage."""
    r = random.Random(5)
    base = [f"b{r.randrange(10**6)}" for _ in range(90)]

    def edited(given, k):
        out = list(given)
        for _ in range(k):
            out[r.randrange(len(out))] = f"e{r.randrange(12)}"
        return out

    rows = [edited(base, r.choice([1, 2, 2, 3, 4, 5, 6])) for _ in range(n_first)]
    other = edited(base, 8)
    rows += [edited(other, r.choice([0, 1, 2, 3, 4])) for _ in range(n_second)]
    rows += [base[:30] + [f"o{r.randrange(10**6)}" for _ in range(70)] for _ in range(n_passage)]
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def classes(rows):
    """doc_id -> (size, smallest doc_id reached), by comparing all pairs."""
    sets = [s for _, s in ngram_join.shingle_sets([t for _, t in rows])]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and find(i) != find(j) and ngram_join.similar(sets[i], sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("small, levels, local", [(2000, 5, 500_000), (6, 2, 10)])
def test_jaccard_of_large_groups(spark, monkeypatch, small, levels, local):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    monkeypatch.setattr(ngram_join, "MAX_LOCAL_LINKS", local)
    rows = family(140, 60, 30) if small < 100 else family(260, 120, 60)
    wanted = classes(rows)
    assert len({c for _, c in wanted.values()}) > 50
    deeper, delta_entries = [], ngram_join.delta_entries
    monkeypatch.setattr(ngram_join, "delta_entries", lambda *given: (deeper.append(1), delta_entries(*given))[1])
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert bool(deeper) == (small < 100)


def test_jaccard_writes_small_tables_in_few_files(spark):
    rows = family(140, 60, 30)
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "ballast")
    earlier = set(folder.glob("*"))
    try:
        for key, value in many.items():
            spark.conf.set(key, value)
        found = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == classes(rows)
    written = {p.name: len(list(p.glob("part-*"))) for p in set(folder.glob("*")) - earlier if not p.name.startswith("shared-keys")}
    assert len(written) > 8 and max(written.values()) <= 2 * spark.sparkContext.defaultParallelism


# URL rules


def test_url_rules_of_long_urls_and_few_labels(spark):
    long = "https://h.org/" + "/".join(f"word{chr(97 + k)}" for k in range(24))
    pages = [(k, f"https://h.org/{'ab'[k % 2]}") for k in range(50)] + [(k, long) for k in range(50, 70)]
    labels = spark.createDataFrame([(k, k == 50) for k in range(51)], "page_id long, block boolean")
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert {r["verdict"] for r in url_rules.judge(df, labels).collect()} == {"allow"}
    labels = spark.createDataFrame([(k, k >= 50) for k in range(70)], "page_id long, block boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, labels).collect()}
    assert all((v == "block") == (k >= 50) for k, v in got.items()) and len(got) == 70


def test_url_rules_against_brute_force(spark):
    r = random.Random(3)
    names = list("abcdef")
    sets = []
    for _ in range(160):
        tokens = {t for t in names if r.random() < 0.45}
        sets.append((sorted(tokens | ({"twin"} if "a" in tokens else set())), (("a" in tokens and "b" in tokens) or r.random() < 0.3)))
    least, confident = 16, 0.6
    wanted = set()  # minimal rules
    for n in range(1, len(names) + 1):
        for part in map(frozenset, combinations(names, n)):
            rows = [b for t, b in sets if part <= set(t)]
            if sum(rows) >= least and sum(rows) >= confident * len(rows):
                c = sum(rows) / len(rows)
                if not any(p < part and q >= c for p, q in wanted):
                    wanted.add((part, c))
    df = spark.createDataFrame(sets, "tokens array<string>, block boolean")
    rules, items = url_rules.mine_rules(df, least / len(sets), confident)
    assert {(frozenset(x["antecedent"]), round(x["confidence"], 9)) for x in rules.collect()} == {(p, round(c, 9)) for p, c in wanted}
    assert ("twin", "a") in {tuple(x) for x in items.collect()}
    asked = [sorted(c) for n in range(1, 7) for c in combinations([*names[1:], "twin"], n)]
    found = {tuple(x["tokens"]) for x in url_rules.match_rules(spark.createDataFrame([(a,) for a in asked], "tokens array<string>"), rules, items).collect()}
    assert found == {tuple(a) for a in asked if any(p <= {"a" if t == "twin" else t for t in a} for p, _ in wanted)}


# whole texts against whole items


def leaks_by_comparing(docs, items, threshold=decontam.THRESHOLD, wanted=decontam.OVERLAP):
    """The pairs (doc, item) that ``leaks`` finds, by scoring every passage against every item."""
    indexes = decontam.Indexes(items).indexes
    found = set()
    for doc, text in docs:
        own = decontam.words_of(text)
        for index in indexes:
            for begin in range(0, len(own), index.width):
                passage = own[begin : begin + 2 * index.width]
                for k, item in enumerate(index.ids):
                    score = sum(index.impacts[t][index.postings[t].index(k)] for w in set(passage) if (t := index.terms.get(w, -1)) >= 0 and k in index.postings[t])
                    if score >= threshold - 1e-9 and all(decontam.overlap(part, passage) >= wanted for part in decontam.question_and_answer(index.texts[k])):
                        found.add((doc, item))
    return found


def test_leaks_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    pool = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(pool, k=r.choice([6, 14, 25, 40, 90]))) + ". " + " ".join(r.choices(pool, k=r.choice([3, 9]))) + ".") for k in range(40)]
    docs = []
    for k in range(60):
        parts = [" ".join(r.choices(pool, k=r.randrange(5, 200)))]
        for _ in range(r.randrange(3)):
            text = r.choice(items)[1].split()
            if r.random() < 0.5:
                text[r.randrange(len(text))] = "changed"
            parts.append(" ".join(text if r.random() < 0.6 else text[: 2 * len(text) // 3]))
            parts.append(" ".join(r.choices(pool, k=r.randrange(3, 100))))
        docs.append((k, "\n".join(parts)))
    wanted = leaks_by_comparing(docs, items)
    assert len(wanted) > 20
    table = spark.createDataFrame(items, "item_id long, text string")
    for group, cells in ((1 << 16, 1 << 22), (64, 50)):
        monkeypatch.setattr(decontam, "GROUP", group)
        monkeypatch.setattr(decontam, "CELLS", cells)
        found = decontam._scanned.__wrapped__(frame(spark, docs).toArrow().to_batches(), type("Held", (), {"value": decontam.Indexes(items)}), decontam.THRESHOLD, decontam.OVERLAP)
        assert {(x["doc_id"], x["item_id"]) for batch in found for x in batch.to_pylist()} == wanted
    assert {(x["doc_id"], x["item_id"]) for x in decontam.leaks(frame(spark, docs), table).collect()} == wanted


def test_leaks_in_a_very_long_text(spark):
    item = words(30, 9) + ". " + words(8, 11) + "."
    filler = " ".join(f"x{k % 5000}" for k in range(300_000))
    found = decontam.leaks(frame(spark, [(1, f"{filler} {item} {filler}"), (2, filler)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(x["doc_id"], x["item_id"]) for x in found.collect()] == [(1, 1)]


def test_an_index_of_many_items_is_small():
    import pickle

    items = [(k, " ".join(f"t{(k * 31 + j * 7919) % 90_000}" for j in range(24))) for k in range(6000)]
    assert len(pickle.dumps(decontam.Indexes(items))) < 60 << 20
