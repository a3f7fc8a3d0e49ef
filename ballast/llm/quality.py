"""Quality classifier: ordinal cumulative-link (proportional odds) regression.

Grades 0..K-1 share one weight vector over hashed text features; ordered
thresholds cut the score: ``P(grade <= k) = sigmoid(threshold_k - score)``.
This gives the expected grade and tail probabilities for selection.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import cache, small_batches, task

BITS = 18
#: Beginnings of this length of longer words are features too; compounds and inflected words share them.
PREFIX = 4
#: A beginning is a feature once for each of these numbers of different words that have it.
OFTEN = (1, 2, 3, 5)
#: A document is kept when the chance of the top grade is at least this.
KEEP_FROM = 0.5
#: Texts are cut at white space into parts of about this many characters, for bounded memory.
PART = 1 << 20
_token = re.compile(r"\w+|[^\w\s]+")


def parts_of(text: str, size: int = PART):
    """The text in parts that end at white space, where there is any within the size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


class _Buckets(dict):
    """The bucket of a token in lower case; holds at most LIMIT tokens."""

    LIMIT = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = crc32(token.lower().encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        if len(token) <= 64:
            self[token] = found
        return found


_bucket = _Buckets()
cache("quality", _bucket.clear)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a whole text: words and their beginnings in lower case, runs of symbols, and the shares of capitals and symbols."""
    buckets: set[int] = set()
    begun: Counter[str] = Counter()
    n = upper = symbols = 0
    for part in parts_of(text or ""):
        found = _token.findall(part)
        n += len(found)
        if not part.islower():
            upper += sum(map(str.isupper, found))
        symbols += len(found) - sum(map(str.isalnum, found))
        distinct = set(found)
        buckets.update(map(_bucket.__getitem__, distinct))
        begun.update(w[:PREFIX] for w in distinct if len(w) > PREFIX)
    buckets.update(_bucket[f"{w}\x00{least}"] for w, count in begun.items() for least in OFTEN if count >= least)
    buckets.add(_bucket[f"\x00up{min(8, 16 * upper // n) if n else 0}"])
    buckets.add(_bucket[f"\x00sy{min(12, 16 * symbols // n) if n else 0}"])
    out = np.fromiter(buckets, np.int32, len(buckets))
    out.sort()
    return out


@dataclass
class Model:
    weights: np.ndarray  # float32, by bucket
    thresholds: np.ndarray  # ascending

    @property
    def n_grades(self) -> int:
        return len(self.thresholds) + 1

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the top grade, by row."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, min_rows: int = 10, l2: float = 1e-3, steps: int = 250, rate: float = 0.05) -> Model:
    """Fits by Adam on the mean negative log-likelihood plus ``l2`` times the squared weights.

    Buckets in fewer than ``min_rows`` rows keep weight 0.  With no rows all weights and scores are 0.
    """
    n = len(rows)
    weights = np.zeros(1 << BITS, np.float32)
    thresholds = np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2
    if n == 0:
        return Model(weights, thresholds)
    cols = np.concatenate(rows)
    seen = np.bincount(cols, minlength=1 << BITS)
    used = np.flatnonzero(seen >= min_rows)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    col_of = place[cols]
    row_of, col_of = row_of[col_of >= 0], col_of[col_of >= 0]

    share = (np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] + 0.5) / (n + 1)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    w_end = len(used)
    for step in range(1, steps + 1):
        w = x[:w_end]
        cuts = np.concatenate([[-np.inf], x[w_end] + np.concatenate([[0], np.cumsum(np.exp(x[w_end + 1 :]))]), [np.inf]])
        scores = np.bincount(row_of, w[col_of], n)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        hi, lo = sig(cuts[grades + 1] - scores), sig(cuts[grades] - scores)
        hi[grades == n_grades - 1], lo[grades == 0] = 1, 0
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g = np.zeros_like(x)
        g[:w_end] = np.bincount(col_of, ((d_hi - d_lo) / n)[row_of], w_end) + 2 * l2 * w
        g_cut = np.array([(-d_hi[grades == k].sum() + d_lo[grades == k + 1].sum()) / n for k in range(n_grades - 1)])
        tails = np.cumsum(g_cut[::-1])[::-1]
        g[w_end] = tails[0]
        g[w_end + 1 :] = tails[1:] * np.exp(x[w_end + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[used] = x[:w_end]
    return Model(weights, x[w_end] + np.concatenate([[0], np.cumsum(np.exp(x[w_end + 1 :]))]))


@task("quality")
def _featurised(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], ["grade", "buckets"])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = 12000) -> Model:
    """A model from ``docs(doc_id, text)`` and ``ratings(doc_id, grade)``.

    At most about ``max_rows`` ratings, chosen by a hash of doc_id, are used;
    this bounds what is sent to the driver.  Null ids and grades are left out.
    """
    usable = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).filter(f"doc_id is not null and grade between 0 and {n_grades - 1}")
    total = usable.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.filter(drawn < max_rows / max(1, total))  # about max_rows rows of 12 bytes
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    got = sample.mapInArrow(_featurised, "grade int, buckets array<int>").toArrow()
    lists = got["buckets"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    order = sorted(range(len(rows)), key=lambda i: (got["grade"][i].as_py(), len(rows[i]), rows[i].tobytes()))  # the same model whatever order rows come in
    return fit([rows[i] for i in order], got["grade"].to_numpy()[order], n_grades)


@task("quality")
def _graded(batches, held, with_text=False):
    model: Model = held.value
    for batch in batches:
        texts = batch.column("text").to_pylist()
        scores = np.array([model.weights[features(t)].sum(dtype=np.float64) for t in texts]).reshape(-1)
        below = model.cumulative(scores)
        others = [k for k in batch.schema.names if k != "text" or with_text]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, others), pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, -1])], [*others, "expected_grade", "p_top"]
        )


def _scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as c0, c1 ... (the text, if wanted, as ``text``), expected_grade and p_top."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = [F.col(k).alias(f"c{i}") for i, k in enumerate(keep) if k != "text"]
    types = ", ".join(f"c{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep) if k != "text")
    types += ", text string" * ("text" in keep)
    inner = docs.select(*given, F.col("text").alias("text"))
    return inner.mapInArrow(lambda batches: _graded(batches, held, "text" in keep), f"{types}, expected_grade double, p_top double")


def _renamed(keep: list[str]) -> list[Column]:
    return [F.col("text") if k == "text" else F.col(f"c{i}").alias(k) for i, k in enumerate(keep)]


def grade(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, expected_grade and p_top, the probability of the top grade.

    Whole texts count; a null text is graded like an empty one.
    """
    return _scores(docs, model, keep).select(*_renamed(keep), "expected_grade", "p_top")


def accepted(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose chance of the top grade is at least ``keep_from``, with their own columns."""
    return _scores(docs, model, docs.columns).filter(F.col("p_top") >= keep_from).select(*_renamed(docs.columns))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 toxic, 1 of low quality, 2 neither."""
    return labels.select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade")
    )
