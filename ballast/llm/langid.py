"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language give a matrix of log-probabilities
(languages x buckets), which is broadcast with the languages' log-priors; batches
of texts are scored in numpy by summing the matrix rows of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import small_batches, task

#: Width of the feature space, in bits, and the n of the n-grams.
BITS, ORDERS = 16, (1, 2, 3)
#: Largest log-probability matrix that is broadcast; with very many languages the feature space is narrower.
MAX_MATRIX_BYTES = 256 << 20
#: Characters scored at once, with up to eight languages; with more, fewer.
CHUNK = 1 << 19
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _folded(text: str) -> np.ndarray:
    """Code points in lower case, framed by spaces, with each run of non-letters as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, points, 32)[keep]


def _buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    out = points[: len(points) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out = out * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
    out = (out + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _features(texts: list[str | None], bits: int = BITS, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (row, bucket), in parts of about ``chunk`` characters; texts of any length."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush():
        points = np.concatenate(held)
        rows = np.repeat(owners, [len(h) for h in held])
        for n in ORDERS:
            if len(points) >= n:
                same = rows[: len(rows) - n + 1] == rows[n - 1 :]
                yield rows[: len(rows) - n + 1][same], _buckets(points, n, bits)[same]

    for row, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), chunk):
            points = _folded(text[at : at + chunk])
            if len(points) < 2:
                continue
            held.append(points)
            owners.append(row)
            size += len(points)
            if size >= chunk:
                yield from flush()
                held, owners, size = [], [], 0
    if held:
        yield from flush()


@task("langid")
def _counted(batches, languages: list[str], bits: int):
    index = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << bits), np.int64)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        of = np.array([index[x] for x in langs] or [0])
        for rows, buckets in _features(batch.column("text").to_pylist(), bits):
            np.add.at(counts.reshape(-1), of[rows] * (1 << bits) + buckets, 1)
    k, bucket = counts.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[k, bucket])], ["k", "bucket", "n"])


#: Languages, log-probabilities (languages x buckets) and log-priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def train(labelled: DataFrame, per_language: int = 2000, smoothing: float = 0.5) -> Model:
    """Languages (sorted), log-probabilities and log-priors from rows ``doc_id, text, lang``.

    The n-grams are those of a sample: of each language about ``per_language``
    rows, chosen by a hash of doc_id and language, so that every language has its
    share however rare it is.  The priors are shares of all rows.  Rows without
    text or language don't count; repeated rows count as often as they occur.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 1 << BITS)), np.zeros(0)
    bits = min(BITS, (MAX_MATRIX_BYTES // (8 * len(languages))).bit_length() - 1)
    n = np.array([sizes[k] for k in languages], float)
    priors = np.log(n / n.sum())
    shares = spark.createDataFrame([(k, float(per_language / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(shares), "lang").filter(drawn < F.col("share")).select("lang", "text")
    parts = max(1, min(64, len(languages) * per_language // 1000))
    found = (
        sample.repartition(parts)
        .mapInArrow(lambda batches: _counted(batches, languages, bits), "k int, bucket int, n long")
        .groupBy("k", "bucket").agg(F.sum("n").alias("n"))
        .toArrow()
    )  # at most languages x buckets rows
    counts = np.zeros((len(languages), 1 << bits))
    counts[found["k"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    total = counts.sum(axis=1, keepdims=True)
    logs = np.log(counts + smoothing) - np.log(total + smoothing * (1 << bits))
    return languages, logs, priors


@task("langid")
def _scored(batches, model, with_text=False):
    languages, logs, priors = model.value
    bits, chunk = logs.shape[1].bit_length() - 1, max(1 << 12, 8 * CHUNK // max(8, len(languages)))
    table = np.ascontiguousarray(logs.T)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sums = np.tile(priors, (len(texts), 1))
        seen = np.zeros(len(texts), np.int64)
        if languages:
            for rows, buckets in _features(texts, bits, chunk):
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                np.add.at(sums, rows[starts], np.add.reduceat(table[buckets], starts, axis=0))
                np.add.at(seen, rows[starts], 1)
        names, scores = [], []
        for row, text in enumerate(texts):
            if not seen[row] or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            best = int(sums[row].argmax())
            names.append(languages[best])
            scores.append(float(1 / np.exp(sums[row] - sums[row, best]).sum()))
        others = [k for k in batch.schema.names if k != "text" or with_text]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, others), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"]
        )


def held_out(doc_id: str = "doc_id") -> Column:
    """Is crc32 of the id as text 2 modulo 4?  Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _predicted(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as c0, c1 ... (the text, if wanted, as ``text``), lang_pred and score."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = [F.col(k).alias(f"c{i}") for i, k in enumerate(keep) if k != "text"]
    types = ", ".join(f"c{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep) if k != "text")
    types += ", text string" * ("text" in keep)
    inner = docs.select(*given, F.col("text").alias("text"))
    return inner.mapInArrow(lambda batches: _scored(batches, held, "text" in keep), f"{types}, lang_pred string, score double")


def _renamed(keep: list[str]) -> list[Column]:
    return [F.col("text") if k == "text" else F.col(f"c{i}").alias(k) for i, k in enumerate(keep)]


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, then lang_pred and score (the posterior of lang_pred).

    Whole texts are scored.  A null text, one without letters, and any text
    where no language was learned give ``und`` and 0; of equally likely
    languages the first by name is taken.  Repeated rows give repeated rows.
    """
    return _predicted(docs, model, keep).select(*_renamed(keep), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``min_score`` at least, with their own columns."""
    return _predicted(docs, model, docs.columns).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*_renamed(docs.columns))


def identify(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out.

    A row with a null doc_id isn't learned from and counts as not held out.
    """
    model = train(docs.filter(~held_out()), per_language)
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
