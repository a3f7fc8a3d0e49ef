"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard.

Vectors are dealt into shards of bounded size by length and hash.  A shard's
graph is built in growing batches: greedy searches from the entry propose
neighbours, and relaxed pruning keeps an edge only if no kept neighbour is closer
to its target by the factor ``alpha``, so that edges point in different
directions.  Every shard answers every query by beam search; answers are merged
by exact score, in double precision on the vectors as they were given.

For inner products each vector gets one more component that makes all of a
shard equally long; then the nearest by distance are those of largest product.
The vectors of a shard are of lengths within a factor of two, so that none is
lost beside a much longer one.  The beam is widened until the first queries of a
shard find ``RECALL`` of what comparing them with all of the shard finds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import bounded_broadcast, small_batches, staged, task

#: Vectors of a shard, at most about this many.
SHARD_ROWS = 16_384
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 96, 1.2
#: Beam entries expanded at once (of a wide beam a share of it), queries searched at once, and bytes that may take.
WIDE, SHARE, BLOCK, BYTES = 4, 32, 512, 64 << 20
#: Share of a shard's true nearest that its first queries, so many of them, must find.
RECALL, PROBES = 0.95, 48


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows in double precision, divided by one number so that the longest has length 1; of any finite size."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(initial=1e-300)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=1e-300))


class Graph:
    """A navigable graph over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.originals = vectors
        scaled = unit(vectors)
        extra = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", scaled, scaled), 0))
        self.points = np.concatenate([scaled, extra[:, None]], axis=1).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.degree, self.alpha = degree, alpha
        n = len(vectors)
        self.edges = np.full((n, degree), -1, np.int32)
        #: The points are inserted in an order without meaning; the first is the one nearest to the mean.
        order = np.random.Generator(np.random.PCG64(n)).permutation(n)
        centre = self.points.mean(axis=0)
        self.entry = int((self.squares - 2 * self.points @ centre).argmin())
        order = np.concatenate([[self.entry], order[order != self.entry]])
        self._connect_all(order[: min(n, 2 * degree)])
        done = min(n, 2 * degree)
        while done < n:
            batch = order[done : done + min(BLOCK, max(16, done // 4))]
            ids, distances = self.search(self.points[batch], beam)
            self._insert(batch, ids, distances)
            done += len(batch)
        self._reach_all()

    def _reached(self) -> np.ndarray:
        """For each point: does any path lead to it from the entry?"""
        found = np.zeros(len(self.points) + 1, bool)
        found[self.entry] = True
        front = np.array([self.entry])
        while len(front):
            near = np.unique(self.edges[front])
            front = near[(near >= 0) & ~found[near]]
            found[front] = True
        return found[:-1]

    def _reach_all(self) -> None:
        """Pruning takes some points their last edge in; each gets one from the nearest points that are reached, in columns of their own."""
        while len(lost := np.flatnonzero(~(reached := self._reached()))):
            lost = lost[:BLOCK]
            ids, _ = self.search(self.points[lost], 16)
            more = np.full((len(self.edges), 4), -1, np.int32)
            used = np.zeros(len(self.edges), np.int32)
            for point, near in zip(lost.tolist(), ids.tolist()):
                free = [p for p in near if p >= 0 and reached[p] and used[p] < 4][:4]
                for p in free or [self.entry]:
                    if used[p] < 4:
                        more[p, used[p]] = point
                        used[p] += 1
            self.edges = np.concatenate([self.edges, more], axis=1)

    def _connect_all(self, ids: np.ndarray) -> None:
        if len(ids) > 1:
            candidates = np.broadcast_to(ids, (len(ids), len(ids))).copy()
            candidates[candidates == ids[:, None]] = -1
            self.edges[ids] = self._pruned(ids, candidates)

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, less the queries' squares, from each query to its row of ids; infinite for -1."""
        found = self.squares[ids] - 2 * np.matmul(self.points[ids], queries[:, :, None])[:, :, 0]
        found[ids < 0] = np.inf
        return found

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of each query's beam, nearest first; -1 and infinity fill it up."""
        n_queries = len(queries)
        row = np.arange(n_queries)[:, None]
        ids = np.full((n_queries, beam), -1, np.int32)
        ids[:, 0] = self.entry
        distances = np.full((n_queries, beam), np.inf, np.float32)
        distances[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        is_open = np.zeros((n_queries, beam), bool)
        is_open[:, 0] = True
        seen = np.zeros((n_queries, len(self.points) + 1), bool)  # the last column stands for -1
        seen[:, self.entry] = seen[:, -1] = True
        active = np.arange(n_queries)
        while len(active):
            wide = min(beam, max(WIDE, beam // SHARE))
            best = np.argpartition(np.where(is_open[active], distances[active], np.inf), wide - 1, axis=1)[:, :wide]
            a = active[:, None]
            chosen = np.where(is_open[a, best], ids[a, best], -1)
            is_open[a, best] = False
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[a, near]] = -1
            seen[a, near] = True
            near = -np.sort(-near, axis=1)[:, : max(1, int((near >= 0).sum(axis=1).max()))]
            far = self._distances(queries[active], near)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_far = np.concatenate([distances[active], far], axis=1)
            all_open = np.concatenate([is_open[active], near >= 0], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam] if all_far.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(active), beam))
            r = np.arange(len(active))[:, None]
            ids[active], distances[active], is_open[active] = all_ids[r, keep], all_far[r, keep], all_open[r, keep] & np.isfinite(all_far[r, keep])
            active = active[is_open[active].any(axis=1)]
        order = np.argsort(distances, axis=1, kind="stable")
        return ids[row, order], distances[row, order]

    def _pruned(self, ids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each point up to ``degree`` of its candidates (-1: none), nearest first, each not much closer to a kept one."""
        far = self._distances(self.points[ids], candidates) + self.squares[ids][:, None]
        order = np.argsort(far, axis=1, kind="stable")
        r = np.arange(len(ids))[:, None]
        candidates, far = candidates[r, order], np.maximum(far[r, order], 0)
        points = self.points[candidates]
        between = self.squares[candidates][:, :, None] + self.squares[candidates][:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        alive = np.isfinite(far) & (candidates != ids[:, None])
        kept = np.full((len(ids), self.degree), -1, np.int32)
        rows = np.arange(len(ids))
        for k in range(self.degree):
            if not alive.any():
                break
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            kept[has, k] = candidates[rows, first][has]
            alive &= (self.alpha**2 * np.maximum(between[rows, first], 0) > far) | ~has[:, None]
            alive[rows, first] = False
        return kept

    def _insert(self, batch: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        new = self._pruned(batch, ids)
        self.edges[batch] = new
        # edges back: what fits is added, full rows are pruned anew
        source = np.repeat(batch, self.degree)
        target = new.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        points, starts, counts = np.unique(target, return_index=True, return_counts=True)
        widest = int(counts.max()) if len(counts) else 0
        if not widest:
            return
        more = np.full((len(points), widest), -1, np.int32)
        more[np.repeat(np.arange(len(points)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
        have = (self.edges[points] >= 0).sum(axis=1)
        fits = have + counts <= self.degree
        for p, h, c, m in zip(points[fits].tolist(), have[fits].tolist(), counts[fits].tolist(), more[fits]):
            self.edges[p, h : h + c] = m[:c]
        full = np.flatnonzero(~fits)
        for k in range(0, len(full), 256):
            part = full[k : k + 256]
            self.edges[points[part]] = self._pruned(points[part], np.concatenate([self.edges[points[part]], more[part]], axis=1))

    def exact(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k largest products of all, ties to the smaller id; -1 fills up."""
        scores = queries.astype(np.float64) @ self.originals.astype(np.float64).T
        return self._best(np.broadcast_to(np.arange(len(self.originals)), scores.shape), scores, k)

    @staticmethod
    def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        r = np.arange(len(ids))[:, None]
        return ids[r, order], scores[r, order]

    def beam_for(self, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> int:
        """A beam that finds RECALL of the k nearest of these queries, at most as wide as there are points."""
        n = len(self.points)
        beam = max(beam, k)
        best = self.exact(queries, min(k, n))[1][:, -1:]
        while beam < n:
            found = self.nearest(queries, k, beam)[1]
            if (found >= best).sum() >= RECALL * len(queries) * min(k, n):  # by score, as equal scores are equally near
                return beam
            beam *= 2
        return n

    def nearest(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products in double precision of the k largest products that beam search finds.

        A query that reaches fewer points than there are is compared with all.
        """
        wanted = min(k, len(self.points))
        scale = np.abs(queries).max(axis=1, keepdims=True).astype(np.float64)
        scaled = queries / np.where(scale > 0, scale, 1)
        scaled /= np.maximum(np.sqrt(np.einsum("ij,ij->i", scaled, scaled)), 1e-300)[:, None]
        padded = np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        beam = min(max(beam, k), len(self.points))
        at_once = max(1, BYTES // (max(WIDE, beam // SHARE) * self.edges.shape[1] * self.points.shape[1] * 4))
        ids = np.concatenate([self.search(padded[i : i + at_once], beam)[0] for i in range(0, len(padded), at_once)])
        scores = np.matmul(self.originals[ids].astype(np.float64), queries.astype(np.float64)[:, :, None])[:, :, 0]
        scores[ids < 0] = -np.inf
        few = np.flatnonzero((ids >= 0).sum(axis=1) < wanted)
        ids, scores = self._best(ids, scores, wanted)
        if len(few):
            ids[few], scores[few] = self.exact(queries[few], wanted)
        return ids, scores


@task("ann")
def _answers(batches, k):
    """Of rows sorted by shard and kind (0: a vector, 1: a query) the k best vectors of the shard for each query."""
    shard, graph, ids, vectors, queries, query_ids, beam = None, None, [], [], [], [], 0
    matrix = np.concatenate

    def answered():
        nonlocal graph, queries, query_ids, vectors, beam
        if not queries or not ids:
            queries, query_ids = [], []
            return
        if graph is None:
            graph, vectors = Graph(matrix(vectors)), []
            beam = graph.beam_for(matrix(queries)[:PROBES], k)
        found, scores = graph.nearest(matrix(queries), k, beam)
        asked = np.repeat(np.concatenate(query_ids), found.shape[1])
        found, scores = found.reshape(-1), scores.reshape(-1)
        real = found >= 0
        reps = np.concatenate(ids)[found[real]]
        queries, query_ids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(asked[real]), pa.array(reps), pa.array(scores[real])], ["qrep", "rep", "score"])

    for batch in batches:
        shards, kinds = batch.column("shard").to_pylist(), batch.column("kind").to_numpy()
        numbers, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
        values = lists.flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        cuts = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1] or kinds[i] != kinds[i - 1]), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                yield from answered()
                shard, graph, ids, vectors = shards[a], None, [], []
            part = values[bounds[a] : bounds[b]].reshape(b - a, -1)
            if kinds[a] == 0:
                ids.append(numbers[a:b])
                vectors.append(part)
                continue
            for c in range(0, b - a, BLOCK):
                queries.append(part[c : c + BLOCK])
                query_ids.append(numbers[a + c : min(b, a + c + BLOCK)])
                if sum(map(len, queries)) >= BLOCK:
                    yield from answered()
    yield from answered()


def usable(embedding: str = "embedding") -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows found for every query row of ``vectors(vec_id, embedding)``.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double
    precision, largest first, ties to the smaller vec_id; the query's own row is
    left out.  With fewer candidates there are fewer rows.  Rows whose vector is
    not usable or whose vec_id is null take no part; repeated rows count once;
    vectors are compared with those of as many components; further columns are
    ignored.  Equal vectors are one point of the graph, which stands for its
    k + 1 smallest vec_ids.  A vec_id with several vectors is a candidate with each.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable())
    rows = rows.withColumns({"hash": F.xxhash64("embedding"), "hash2": F.xxhash64(F.lit(1), "embedding")})
    same = ["hash", "hash2"]  # 128 bits stand for a vector
    smallest = Window.partitionBy(*same).orderBy("vec_id")
    members = rows.select(*same, "vec_id").withColumn("nth", F.dense_rank().over(smallest)).filter(F.col("nth") <= k + 1).distinct()
    members = staged(members.select(*same, "vec_id", F.min("vec_id").over(Window.partitionBy(*same)).alias("rep")), "members")
    reps = members.filter("vec_id = rep").select(*same, "rep")
    length = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, b: F.greatest(a, b))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("largest"), 2))
    points = (
        rows.select(*same, F.col("vec_id").alias("rep"), "embedding").join(reps, [*same, "rep"], "left_semi").dropDuplicates([*same, "rep"])
        .withColumn("largest", length)
        .withColumn("class", F.concat_ws(":", F.size("embedding").cast("string"), F.floor(F.log2("largest") + F.log2(squares) / 2).cast("string")))
        .select(*same, "rep", "embedding", "class")
    )  # vectors as long as each other but for a factor of two, with equally many components
    points = staged(points, "points")
    # a row for each class: for every number of components no more than there are powers of two in a double
    counts = staged(points.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select("class", F.ceil(F.col("n") / shard_rows).alias("shards")), "classes")
    n_shards = counts.agg(F.sum("shards")).first()[0] or 0
    counts = bounded_broadcast(counts)
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), *same).distinct().join(reps, same).select("query_id", "rep")
    asked = staged(asked, "asked")
    name = lambda number: F.concat_ws(":", "class", number.cast("string"))
    stored = points.join(counts, "class").select(name(F.pmod(F.xxhash64("rep"), F.col("shards"))).alias("shard"), F.lit(0).alias("kind"), F.col("rep").alias("vec_id"), "embedding")
    asking = points.join(asked.select("rep").distinct(), "rep", "left_semi").withColumn("size", F.substring_index("class", ":", 1))
    sent = asking.select("rep", "embedding", "size").join(counts.withColumn("size", F.substring_index("class", ":", 1)), "size").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("number"), "class", "rep", "embedding"
    )
    sent = sent.select(name(F.col("number")).alias("shard"), F.lit(1).alias("kind"), F.col("rep").alias("vec_id"), "embedding")
    dealt = stored.union(sent).repartition(max(1, min(n_shards, 20_000)), "shard").sortWithinPartitions("shard", "kind", "vec_id")
    found = dealt.mapInArrow(lambda batches: _answers(batches, k + 1), "qrep long, rep long, score double")

    best = lambda by, *order: Window.partitionBy(by).orderBy(F.desc("score"), *order)
    near = found.withColumn("nth", F.row_number().over(best("qrep", "rep"))).filter(F.col("nth") <= k + 1).drop("nth")
    near = near.join(members.select("rep", "vec_id"), "rep").withColumn("nth", F.row_number().over(best("qrep", "vec_id"))).filter(F.col("nth") <= k + 1)
    return (
        asked.withColumnRenamed("rep", "qrep").join(near.select("qrep", "vec_id", "score"), "qrep")
        .filter("vec_id != query_id")
        .withColumn("rank", F.row_number().over(best("query_id", "vec_id"))).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
