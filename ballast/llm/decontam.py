"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The documents of the index are the test items, the queries are all passages of
the training texts.  Impacts are divided by the item's score against its own
text, so that one threshold in (0, 1] holds for items of any length.  Passages
overlap so that every run of words as long as an item lies within one.

1. For each passage the bounds of its terms in each block of items are added
   (numpy, all passages of a batch at once), those of frequent terms as if all
   were there; blocks that stay below the threshold can hold no result.
2. What remains is searched exactly by WAND with the bounds of posting blocks.
3. An item that is found counts as leaked where its question and its answer
   both overlap the passage in word 5-grams.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import bounded_broadcast, row_key, small_batches, staged, task
from ballast.llm.text_hash import U, word_arrays

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Share of the word 5-grams of the question, and of the answer, that a passage must hold.
OVERLAP = 0.6
#: Items of one index; more are searched shard by shard, so that an index has a bounded size.
SHARD = 20_000
#: Items in a block of the index.
BLOCK = 4
#: A term in more blocks than this is frequent.
FREQUENT = 64
#: Words: runs of ASCII letters, digits and underscores, and of any characters beyond ASCII, in lower case.
_word = re.compile("[0-9a-z_\x80-\U0010ffff]+")
_separators = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words up to its last sentence and those of the last; of one sentence the first and the second half."""
    sentences = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def grams(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of the part's word 5-grams (shorter parts: of the whole) that the passage holds; 1 for an empty part."""
    wanted = grams(part)
    if not wanted:
        return 1.0
    return len(wanted & grams(passage, min(5, len(part)))) / len(wanted)


class Statistics:
    """Of all items with words: their number, mean length, and by word how many hold it."""

    def __init__(self, n: int, mean: float, holding: dict[str, int]):
        self.n, self.mean, self.holding = n, mean, holding

    @classmethod
    def of(cls, texts: list[str | None]) -> Statistics:
        bags = [b for b in (words_of(t or "") for t in texts) if b]
        return cls(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(w for b in bags for w in set(b)))


class Index:
    """Items of one length class, in blocks; postings by term, weighed by the statistics of all items."""

    def __init__(self, items: list[tuple[int, str]], width: int, known: Statistics):
        #: Passages are 2 * width words, and begin every width words.
        self.width = width
        items = sorted(items, key=lambda x: (words_of(x[1]), x[0] is None, x[0] or 0))  # like texts share blocks
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        bags = [words_of(t) for t in self.texts]
        self.n_blocks = -(-len(items) // BLOCK)
        found: dict[str, dict[int, int]] = {}
        for k, bag in enumerate(bags):
            for w in bag:
                own = found.setdefault(w, {})
                own[k] = own.get(k, 0) + 1
        idf = {w: math.log(1 + (known.n - known.holding[w] + 0.5) / (known.holding[w] + 0.5)) for w in found}
        impact = lambda w, k, tf: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(bags[k]) / known.mean))
        own = [0.0] * len(items)
        for w, p in found.items():
            for k, tf in p.items():
                own[k] += impact(w, k, tf)
        self.terms = {w: n for n, w in enumerate(sorted(found))}
        self.postings: list[list[int]] = []
        self.impacts: list[list[float]] = []
        #: By term the blocks that hold it, and the largest impact in each.
        self.blocks: list[list[int]] = []
        self.maxima: list[list[float]] = []
        for w in self.terms:
            items_of = sorted(found[w])
            values = [impact(w, k, found[w][k]) / own[k] for k in items_of]
            self.postings.append(items_of)
            self.impacts.append(values)
            largest: dict[int, float] = {}
            for k, v in zip(items_of, values):
                largest[k // BLOCK] = max(largest.get(k // BLOCK, 0.0), v)
            self.blocks.append(list(largest))
            self.maxima.append(list(largest.values()))
        # bounds of the rarer terms by term and block, and what all frequent terms can add in a block
        self.frequent = np.zeros(self.n_blocks)
        rarer = [len(b) <= FREQUENT for b in self.blocks]
        for blocks, maxima, rare in zip(self.blocks, self.maxima, rarer):
            if not rare:
                self.frequent[blocks] += maxima
        self.bound_block = np.array([b for own, rare in zip(self.blocks, rarer) if rare for b in own], np.int64)
        self.bound = np.array([v for own, rare in zip(self.maxima, rarer) if rare for v in own])
        self.bound_from = np.concatenate([[0], np.cumsum([len(b) if rare else 0 for b, rare in zip(self.blocks, rarer)])]).astype(np.int64)

    def most(self, term: int, block: int) -> float:
        """The largest impact of a term in a block."""
        own = self.blocks[term]
        at = bisect_left(own, block)
        return self.maxima[term][at] if at < len(own) and own[at] == block else 0.0

    def search(self, terms: list[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items of the given blocks whose score for the distinct terms reaches the threshold, by block-max WAND."""
        found = []
        for block in blocks:
            end = (block + 1) * BLOCK
            cursors = []
            for t in terms:
                if (most := self.most(t, block)) > 0:
                    at = bisect_left(self.postings[t], block * BLOCK)
                    cursors.append([self.postings[t][at], at, t, most])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[3]
                    if bound >= threshold - 1e-9:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                score, left = 0.0, []
                for c in cursors:
                    item, at, t, most = c
                    own = self.postings[t]
                    if item < pivot:
                        at = bisect_left(own, pivot, at)
                    if at < len(own) and own[at] == pivot:
                        score += self.impacts[t][at]
                        at += 1
                    if at < len(own) and own[at] < end:
                        left.append([own[at], at, t, most])
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                cursors = left
        return found


class Indexes:
    """Indexes by length class, items of up to 16, 32, 64 ... words, and their joint vocabulary; items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]], known: Statistics | None = None):
        known = known or Statistics.of([t for _, t in items])
        classes: dict[int, list[tuple[int, str]]] = {}
        for item_id, text in items:
            if n := len(words_of(text or "")):
                classes.setdefault(max(16, 1 << (n - 1).bit_length()), []).append((item_id, text))
        self.indexes = [Index(own, width, known) for width, own in sorted(classes.items())]
        words = sorted({w for index in self.indexes for w in index.terms})
        hashes = np.array([next(word_arrays([w], _separators))[0] for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        #: By index: the term of each place in ``hashes``, or -1.
        self.terms = [np.array([index.terms.get(words[k], -1) for k in order], np.int64) for index in self.indexes]
        # where to look for a hash: its upper bits give a first place in the sorted table
        self.bits = max(8, len(words).bit_length() + 3)
        self.first = np.searchsorted(self.hashes >> U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the hashes that are in the vocabulary, and their places in the table."""
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.first[slot + 1] > self.first[slot])
        found = np.searchsorted(self.hashes, hashes[at])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == hashes[at]
        return at[same], found[same]


def scan(held: Indexes, rows: list[tuple[int, np.ndarray]], threshold: float):
    """(row, item, index, first word and width of the passage, score) of all items found in the texts' word hashes."""
    sizes = np.array([len(w) for _, w in rows])
    all_at, all_found = held.look_up(np.concatenate([w for _, w in rows]))
    first_word = np.cumsum(sizes) - sizes
    all_rows = np.searchsorted(first_word, all_at, "right") - 1
    for index, terms in zip(held.indexes, held.terms):
        width, n_blocks = index.width, index.n_blocks
        known = terms[all_found]
        inside = known >= 0
        at, row_of, known = all_at[inside], all_rows[inside], known[inside]
        # spans of width words, that begin anew in each text; a passage is a span and the next of the same text
        spans = -(-sizes // width)
        first_span = np.cumsum(spans) - spans
        place, total = first_span[row_of] + (at - first_word[row_of]) // width, int(spans.sum())
        earlier = place > first_span[row_of]
        n_terms = len(index.terms)
        pairs = np.sort(np.concatenate([place, place[earlier] - 1]) * n_terms + np.concatenate([known, known[earlier]]))
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        place, known = pairs // n_terms, pairs % n_terms  # each passage's distinct terms
        # block bounds of the passages, so many at once: the rarer terms' own, and all of the frequent ones
        at_once = max(1, CELLS // n_blocks)
        for low in range(0, total, at_once):
            high = min(total, low + at_once)
            begin, end = np.searchsorted(place, [low, high])
            terms_of, place_of = known[begin:end], place[begin:end]
            n = index.bound_from[terms_of + 1] - index.bound_from[terms_of]
            entry = np.repeat(index.bound_from[terms_of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cells = np.repeat((place_of - low) * n_blocks, n) + index.bound_block[entry]
            bounds = np.bincount(cells, index.bound[entry], (high - low) * n_blocks).reshape(high - low, n_blocks)
            span, block = np.nonzero(bounds >= threshold - index.frequent - 1e-9)
            starts, ends = np.searchsorted(place_of, span + low), np.searchsorted(place_of, span + low + 1)
            span_row = np.searchsorted(first_span, span + low, "right") - 1
            for k, b, row, start, stop in zip((span + low).tolist(), block.tolist(), span_row.tolist(), starts.tolist(), ends.tolist()):
                for item, score in index.search(terms_of[start:stop].tolist(), [b], threshold):
                    yield rows[row][0], item, index, (k - int(first_span[row])) * width, score


#: Words of several documents looked at together; longer documents are cut into spans of so many words that overlap by a passage.
GROUP = 1 << 16
#: Passages times blocks whose bounds are in memory at once.
CELLS = 1 << 22


class Words:
    """Any run of words of a text, without a list of all."""

    EVERY = 1024

    def __init__(self, text: str):
        self.text = text.lower()
        self.marks = [m.start() for k, m in enumerate(_word.finditer(self.text)) if k % self.EVERY == 0]

    def between(self, begin: int, end: int) -> list[str]:
        if begin // self.EVERY >= len(self.marks):
            return []
        found = _word.finditer(self.text, self.marks[begin // self.EVERY])
        return [m[0] for m in islice(found, begin % self.EVERY, end - begin + begin % self.EVERY)]


@task("decontam")
def _scanned(batches, held, threshold, wanted):
    indexes = held.value
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").to_pylist()
        best: dict[tuple, tuple[float, float, float]] = {}
        words: dict[int, Words] = {}  # of the row looked at last
        group: list[tuple[tuple[int, int], np.ndarray]] = []  # (row, first word) and hashes
        n = 0

        def flush():
            for (row, first), item, index, begin, score in scan(indexes, group, threshold):
                if row not in words:
                    words.clear()
                    words[row] = Words(texts[row])
                passage = words[row].between(first + begin, first + begin + 2 * index.width)
                question, answer = (overlap(part, passage) for part in question_and_answer(index.texts[item]))
                if question >= wanted and answer >= wanted:
                    found = (score, question, answer)
                    key = (row, index.ids[item])
                    best[key] = max(best.get(key, found), found)

        # a document's parts begin where a span of every width begins; each reaches a passage into the next
        widest = max((index.width for index in indexes.indexes), default=1)
        step, beyond = -(-GROUP // widest) * widest, 2 * widest
        for row, hashes in enumerate(word_arrays(texts, _separators, str.lower) if indexes.indexes else ()):
            for first in range(0, len(hashes), step):
                group.append(((row, first), hashes[first : first + step + beyond]))
                n += len(group[-1][1])
                if n >= GROUP:
                    flush()
                    group, n = [], 0
        if group:
            flush()
        keys = sorted(best, key=repr)
        columns = [pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.int64())]
        columns += [pa.array([best[k][j] for k in keys], pa.float64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])


@task("decontam")
def _item_words(batches):
    """(shard, word, n, total) of the items of a batch: how many hold a word; under no word their number and their words in all."""
    for batch in batches:
        found: dict[tuple[int, str | None], list[int]] = {}
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
            if bag := words_of(text or ""):
                for word in (None, *set(bag)):
                    own = found.setdefault((shard, word), [0, 0])
                    own[0] += 1
                    own[1] += len(bag)
        columns = [[s for s, _ in found], [w for _, w in found], [n for n, _ in found.values()], [t for _, t in found.values()]]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "word", "n", "total"])


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, wanted: float = OVERLAP) -> DataFrame:
    """The test items of ``items(item_id, text)`` that texts of ``docs(doc_id, text)`` hold.

    One row per document row and item: doc_id, item_id, score (the best
    passage's BM25 score as a share of the item's own), question_overlap,
    answer_overlap.  Whole texts are searched.  Null and empty texts hold
    nothing and items without words are not searched for; repeated rows give
    repeated findings; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select("doc_id", "text")
    types = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    n_shards = max(1, -(-items.count() // SHARD))
    shard_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards))
    known, out = None, None
    if n_shards > 1:
        counted = items.select(shard_of.alias("shard"), "text").mapInArrow(_item_words, "shard long, word string, n long, total long")
        by_shard = staged(counted.groupBy("shard", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "item-words")
        in_all = staged(by_shard.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
        every = by_shard.filter("word is null").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    for shard in range(n_shards):
        if n_shards > 1:
            holding = in_all.join(by_shard.filter((F.col("shard") == shard) & F.col("word").isNotNull()).select("word"), "word", "left_semi")
            known = Statistics(every["n"] or 0, (every["total"] or 0) / max(1, every["n"] or 0), dict(map(tuple, holding.collect())))  # the words of about SHARD items
        own = items.filter(shard_of == shard) if n_shards > 1 else items
        rows = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()]  # about SHARD rows
        held = spark.sparkContext.broadcast(Indexes(rows, known))
        found = given.mapInArrow(lambda batches, held=held: _scanned(batches, held, threshold, wanted), types)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns; each row by its own text, whatever its doc_id."""
    keyed = docs.withColumn("__row", row_key())
    found = staged(leaks(keyed.select(F.col("__row").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__row")).distinct(), "leaks")
    return keyed.join(bounded_broadcast(found), "__row", "left_anti").select(*docs.columns)
