"""Exact Jaccard join of documents on word 5-grams, by universe partitioning.

Two sets with a Jaccard similarity of 0.8 or more differ in at most
``H = (|x| + |y|) / 9`` elements.  The universe of shingles is cut by hash into
``M`` segments, as many as the size band asks for.  By the pigeonhole principle,
if segment ``i`` may differ in fewer than ``v_i`` elements and the ``v_i`` sum to
more than ``H``, some segment does.  ``v_i = 1`` asks for equal segments;
``v_i = 2`` also meets segments that differ by one element, through the segment's
one-deletion neighbourhood.

* Which of the two a size band uses, and ``M``, follow from estimated costs
  (``Scheme``).
* Every document indexes all its segments.  A segment whose key nobody else has
  costs nothing to probe; each document probes its cheapest segments until
  their ``v_i`` suffice, so most documents probe nothing at all.
* Documents with equal sets are one node.  In each key's group all members are
  compared with the most central one, its hub; groups that thereby become one
  component are done.
* Groups that are left in which up to ``SMALL`` nodes ask, or up to ``SMALL``
  answer, compare the rest in pairs.  A sketch of parities, in which two sets differ in no more bits than they have
  different elements, first drops pairs that differ too much.
* Larger ones are cut by what their members differ in from their hub
  (``delta_entries``): a member that is not similar to the hub can only be
  similar to one that shares some of its differences, so the rarest of these
  become the keys of smaller groups, with which all begins anew.  So the work
  grows with the members of a group, not with their pairs.
* Candidates are verified on their whole sets.

Sets are held as 64-bit hashes of the shingles.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import bounded_broadcast, few_files, fresh_path, row_key, small_batches, staged, task
from ballast.llm.text_hash import U as _U
from ballast.llm.text_hash import mix as _mix
from ballast.llm.text_hash import word_arrays

WORDS = 5
#: Size bands begin at these sizes and each is so many times as wide as the one before.
FIRST, RATIO = 5, 1.5
#: A key's members whose number isn't known yet are passed on when so many are held.
MAX_HELD = 50_000
#: A group is compared in pairs if no more than so many of its nodes ask or no more than so many answer.
SMALL = 2000
#: Groups that are still larger after so many levels of smaller groups are compared in pairs nevertheless.
LEVELS = 5
#: Bytes of a broadcast table of hubs' sets; beyond it the join shuffles.
MAX_BROADCAST_BYTES = 16 << 20
#: Links whose components one task finds; beyond it they are found in rounds of stars.
MAX_LOCAL_LINKS = 500_000

#: Byte by byte: white space to the space, A-Z to lower case.
_space = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_mult = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 63, WORDS, dtype=np.uint64) | _U(1)


def _shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one document's word hashes."""
    if len(words) == 0:
        return words
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _mult[k]
    return np.unique(_mix(out))


def shingle_sets(texts: list[str | None]):
    """(row, sorted distinct hashes) of every text, in order."""
    for row, words in enumerate(word_arrays(texts, _space)):
        yield row, _shingles(words)


class Scheme:
    """How sets of ``low`` to ``high`` elements are cut: ``m`` segments, each of which may stand for ``v`` units."""

    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        units = 2 * high // 9 + 1
        options = []
        for v in (1, 2):
            m = ceil(ceil(units / v) * 1.15) + (4 if v == 1 else 1)
            load = (low + high) / 2 / m
            weak = m * exp(-load) * (1 + load)  # segments of at most one element, which many sets may share
            entries = m + (v - 1) * (low + high) / 2
            options.append((entries + 4 * weak, v, m))
        _, self.v, self.m = min(options)


@lru_cache(maxsize=200)
def _scheme(number: int) -> Scheme:
    low = FIRST
    for _ in range(number):
        low = max(low + 1, int(low * RATIO))
    return Scheme(number, low, max(low + 1, int(low * RATIO)) - 1)


def native_scheme(n: int) -> Scheme | None:
    """The scheme of a set of n elements; None for sets too small for any partner of another content that is not larger."""
    if n < FIRST:
        return None
    number = 0
    while _scheme(number).high < n:
        number += 1
    return _scheme(number)


def foreign_scheme(n: int) -> Scheme | None:
    """The next larger scheme, if a partner may lie there."""
    own = native_scheme(n)
    above = _scheme(0 if own is None else own.number + 1)
    return above if 5 * n >= 4 * above.low else None


def _keys(shingles: np.ndarray, scheme: Scheme, only: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and tags (segment, then bit 0: a one-deletion key) of a set; of ``only`` the largest segments, if given."""
    m = _U(scheme.m)
    segment = ((shingles >> _U(32)) * m >> _U(32)).astype(np.int64)
    mixed = _mix(shingles + _U(0x632BE59BD9B4E019))
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    cuts = np.searchsorted(segment, np.arange(scheme.m + 1))
    totals = sums[cuts[1:]] - sums[cuts[:-1]]
    place = np.arange(scheme.m, dtype=np.uint64) * _U(0xD1B54A32D192ED03) + np.array([scheme.number + 1], np.uint64) * _U(0xABC98388FB8FAC03)
    chosen = np.arange(scheme.m)
    if only is not None and only < scheme.m:
        chosen = np.sort(np.argsort(cuts[:-1] - cuts[1:], kind="stable")[:only])
    keys, tags = totals[chosen] + place[chosen], chosen << 3
    if scheme.v == 2:
        wanted = np.isin(segment, chosen) if len(chosen) < scheme.m else np.ones(len(segment), bool)
        of = segment[wanted]
        keys = np.concatenate([keys, totals[of] - mixed[wanted] + place[of]])
        tags = np.concatenate([tags, of << 3 | 1])
    return _mix(keys), tags


def node_of(shingles: np.ndarray) -> int:
    """The identity of a set: a 64-bit hash of its content."""
    if len(shingles) == 0:
        return 0
    return int(_mix(np.array([np.add.reduce(_mix(shingles)) + _U(len(shingles))], np.uint64)).view(np.int64)[0])


_ENTRY = "key long, node long, tag int, sketch array<long>"
#: Bits of a sketch: the parities of the number of elements by hash.  Sets that differ in n elements differ in n bits at most.
SKETCH_BITS = 1024


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@task("ngram_join")
def _entries(batches):
    """For each document a row (key: node, node: doc_id, tag: -1 - size), and once for each set that this task sees its keys."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        keys, nodes, tags, rows = [], [], [], 0
        doc_rows = []

        def flush():
            k = np.concatenate([*keys, np.array([d[0] for d in doc_rows], np.int64)])
            t = np.concatenate([*tags, np.array([d[2] for d in doc_rows], np.int32)]).astype(np.int32)
            n = pa.concat_arrays([pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64)), pa.array([d[1] for d in doc_rows], pa.int64())])
            sketches = pa.concat_arrays([pa.nulls(len(k) - len(doc_rows), pa.list_(pa.int64())), pa.array([d[3] for d in doc_rows], pa.list_(pa.int64()))])
            return pa.RecordBatch.from_arrays([pa.array(k), n, pa.array(t), sketches], ["key", "node", "tag", "sketch"])

        for row, shingles in shingle_sets(batch.column("text").to_pylist()):
            node, size = node_of(shingles), len(shingles)
            doc_rows.append((node, ids[row], -1 - size, sketch_of(shingles) if size >= 4 else None))
            if size < 4 or node in seen:
                continue
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(node)
            if (own := native_scheme(size)) is not None:
                found, tag = _keys(shingles, own, None)
                keys.append(found.view(np.int64))
                tags.append(tag)
                nodes.append(np.full(len(found), node))
                rows += len(found)
            if (above := foreign_scheme(size)) is not None:
                most = min(size * 5 // 4, above.high)
                found, tag = _keys(shingles, above, ceil(((size + most) // 9 + 1) / above.v))
                keys.append(found.view(np.int64))
                tags.append(tag | 2)
                nodes.append(np.full(len(found), node))
                rows += len(found)
            if rows >= 200_000:
                yield flush()
                keys, nodes, tags, doc_rows, rows = [], [], [], [], 0
        yield flush()


@task("ngram_join")
def _shared_keys(batches):
    """Of entries sorted by key and node those whose key may link two nodes, with the number of its nodes; document rows as they are.

    A key's members are held until the next key begins, but no more than
    MAX_HELD: then they are passed on with the number so far, which is only
    used as a cost.
    """
    held: list[np.ndarray] = []  # key, node, tag columns of the open key
    passed = False

    def out(keys, nodes, tags, counts):
        none = pa.nulls(len(keys), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(tags), none, pa.array(counts)], ["key", "node", "tag", "sketch", "c"])

    def closed(keys, nodes, tags):
        if len(keys) == 0:
            return None
        new_key = np.r_[True, keys[1:] != keys[:-1]]
        fresh = np.r_[True, (nodes[1:] != nodes[:-1]) | (tags[1:] != tags[:-1])] | new_key
        keys, nodes, tags, new_key = keys[fresh], nodes[fresh], tags[fresh], new_key[fresh]
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.r_[starts, len(keys)])
        whole = np.add.reduceat((tags & 1) == 0, starts) > 0
        several = np.repeat((sizes > 1) & whole, sizes)
        return out(keys[several], nodes[several], tags[several], np.repeat(sizes, sizes)[several].astype(np.int64)) if several.any() else None

    for batch in batches:
        tags = batch.column("tag").to_numpy()
        docs = tags < 0
        if docs.any():
            part = batch.filter(pa.array(docs))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.zeros(part.num_rows, np.int64))], ["key", "node", "tag", "sketch", "c"])
            batch = batch.filter(pa.array(~docs))
            tags = batch.column("tag").to_numpy()
        if batch.num_rows == 0:
            continue
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if held:
            keys, nodes, tags = (np.concatenate([h, x]) for h, x in zip(held, (keys, nodes, tags)))
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key goes on
        if cut and passed:  # the rest of a key of which a part was passed on
            first = int(np.searchsorted(keys, keys[0], "right"))
            yield out(keys[:first], nodes[:first], tags[:first], np.full(first, MAX_HELD, np.int64))
            keys, nodes, tags, cut, passed = keys[first:], nodes[first:], tags[first:], cut - first, False
        if (done := closed(keys[:cut], nodes[:cut], tags[:cut])) is not None:
            yield done
        held = [keys[cut:], nodes[cut:], tags[cut:]]
        if len(held[0]) > MAX_HELD:
            yield out(*held, np.full(len(held[0]), MAX_HELD, np.int64))
            held, passed = [x[:0] for x in held], True
    if held and len(held[0]):
        if passed:
            yield out(*held, np.full(len(held[0]), MAX_HELD, np.int64))
        elif (done := closed(*held)) is not None:
            yield done


@task("ngram_join")
def _needs(batches):
    """Adds to (node, rep, n) what a set must probe in its own scheme: need, capacity and units of a segment."""
    for batch in batches:
        found = []
        for n in batch.column("n").to_pylist():
            own = native_scheme(n)
            found.append((0, 0, 1) if own is None else (2 * n // 9 + 1, own.m * own.v, own.v))
        columns = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in columns)], [*batch.schema.names, "need", "capacity", "units"])


@task("ngram_join")
def _sets(batches):
    for batch in batches:
        nodes, blobs = [], []
        for _, shingles in shingle_sets(batch.column("text").to_pylist()):
            nodes.append(node_of(shingles))
            blobs.append(shingles.tobytes())
            if len(blobs) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])
                nodes, blobs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets 0.8 or more?"""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


@task("ngram_join")
def _verified(batches):
    for batch in batches:
        sets = zip(batch.column("set_a"), batch.column("set_b"))
        keep = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, files: int | None = None) -> DataFrame:
    """(node, shingles) of the distinct nodes of ``wanted``, made anew from one document each."""
    wanted = staged(wanted.distinct().join(nodes.select("node", "rep"), "node"), "wanted", files)
    reps = bounded_broadcast(wanted.select(F.col("rep").alias("__rep")).distinct())
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(F.col("__rep")), "left_semi").select("text")
    return staged(texts.mapInArrow(_sets, "node long, shingles binary").join(bounded_broadcast(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets", files)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those whose ``sets(node, shingles)`` are similar."""
    joined = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        .select("a", "b", "set_a", "set_b")
    )
    return joined.mapInArrow(_verified, "a long, b long")


@task("ngram_join")
def _differences(batches):
    """Of (hub, node, apart, hub_set, set): sizes, the elements that only one of both has, and whether both are similar."""
    for batch in batches:
        sizes, hub_sizes, elements = [], [], []
        for h, x in zip(batch.column("hub_set"), batch.column("set")):
            h, x = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)
            sizes.append(len(x))
            hub_sizes.append(len(h))
            elements.append(np.setxor1d(h, x, assume_unique=True).view(np.int64))
        n, hub_n, d = (np.array(v, np.int32) for v in (sizes, hub_sizes, list(map(len, elements))))
        offsets = np.concatenate([[0], np.cumsum(d)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(elements) if elements else np.zeros(0, np.int64)))
        columns = [*(batch.column(c) for c in ("hub", "node", "apart")), pa.array(n), pa.array(hub_n), pa.array(d), pa.array(9 * d <= n + hub_n), lists]
        yield pa.RecordBatch.from_arrays(columns, ["hub", "node", "apart", "n", "hub_n", "d", "linked", "elements"])


def delta_entries(family: DataFrame, sets: DataFrame, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of hubs with their members, and entries of smaller groups for the members that are not similar to them.

    ``family`` has distinct rows (hub, node, apart): apart, if they are in
    different components.  Let ``d(x)`` be the number of elements in which x
    differs from its hub h, ``x*`` the set of these.  Similar sets differ in
    ``H(x, y) = (|x| + |y|) / 9`` elements at most, and x and y differ in
    ``d(x) + d(y) - 2 |x* & y*|``, so they must share
    ``(d(x) + d(y) - H(x, y)) / 2`` of x* and y*.  As an x that is apart has
    ``9 d(x) > |x| + |h|``, and as ``d(y) >= ||y| - |h||``, this is

    * for x at least ``(9 d(x) - |x| - |h|) / 18``, whatever y is,
    * for y at least ``(9 d(y) - |y| + |h| + 1) / 18``, whatever x is,

    and at least 1.  With the rarest elements first, the first element that they
    share is among so many: ``d`` less that number, plus 1.  Those are the keys
    under which x asks and y answers.
    """
    hubs = staged(sets.join(bounded_broadcast(family.select(F.col("hub").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("hub"), F.col("shingles").alias("hub_set")), "hubs", files)
    size = hubs.agg(F.sum(F.octet_length("hub_set"))).first()[0] or 0
    hubs = F.broadcast(hubs) if size <= MAX_BROADCAST_BYTES else hubs
    rows = family.join(sets.select("node", F.col("shingles").alias("set")), "node").join(hubs, "hub").select("hub", "node", "apart", "hub_set", "set")
    rows = staged(rows.mapInArrow(_differences, "hub long, node long, apart boolean, n int, hub_n int, d int, linked boolean, elements array<long>"), "differences", files)
    links = rows.filter("apart and linked").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    asks = F.col("apart") & ~F.col("linked")
    of_x = F.when(asks, F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((9 * F.col("d") - F.col("n") - F.col("hub_n")) / 18))).otherwise(0)
    of_y = F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((9 * F.col("d") - F.col("n") + F.col("hub_n") + 1) / 18))
    open_hubs = rows.filter(asks).select("hub").distinct()
    each = rows.join(bounded_broadcast(open_hubs), "hub", "left_semi").select("hub", "node", "n", of_x.alias("of_x"), of_y.alias("of_y"), F.explode("elements").alias("element"))
    often = staged(each.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("c")), "often", files)
    by_member = Window.partitionBy("hub", "node")
    placed = (
        each.join(bounded_broadcast(often.filter("c > 1")), ["hub", "element"], "left").fillna(1, ["c"])
        .withColumn("place", F.row_number().over(by_member.orderBy("c", "element")))
        .withColumn("central", F.avg(F.log2("c")).over(by_member))
        .filter((F.col("c") > 1) & ((F.col("place") <= F.col("of_x")) | (F.col("place") <= F.col("of_y"))))
    )
    return links, placed.select(
        F.xxhash64("hub", "element").alias("key"), "node", "n", F.lit(False).alias("foreign"), F.lit(False).alias("deleted"),
        (F.col("place") <= F.col("of_x")).alias("probe"), (F.col("place") <= F.col("of_y")).alias("answers"), F.floor(F.col("central") * 1000).alias("central"),
    )


@task("ngram_join")
def _united(batches):
    """(node, comp) of the links (a, b), by union and find; comp is the smallest node of a component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], ["node", "comp"])


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, comp): for each node of the links (a, b) the smallest node it reaches.

    Up to MAX_LOCAL_LINKS links one task unites; more are brought down to stars
    by alternating large and small stars.
    """
    if links.limit(MAX_LOCAL_LINKS + 1).count() <= MAX_LOCAL_LINKS:
        return links.coalesce(1).mapInArrow(_united, "node long, comp long")
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges", files)
    while True:
        both = edges.select("u", "v", F.lit(1).alias("down")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
        # a star's outer nodes have one edge, down to its centre, which has none
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
        ends = staged(ends.select("u", F.least("u", "m").alias("m"), ((F.col("down") > 0) & (F.col("n") > 1)).alias("deep")), "ends", files)
        if ends.filter("deep").isEmpty():
            break
        large = both.join(ends, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        down = staged(large.groupBy("u").agg(F.min("v").alias("m")), "down", files)
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u > v").distinct(), "edges", files)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _pairs(one: str, other: str, first: bool):
    """Do two entries of one key, of different nodes, make a candidate?  Of the first groups the larger set probes, or one that came from a smaller band."""
    x, y = (lambda c: F.col(f"{one}{c}")), (lambda c: F.col(f"{other}{c}"))
    probing = (x("probe") & y("answers")) | (y("probe") & x("answers"))
    if first:
        probing = (x("foreign") | y("foreign")) | F.when(x("n") > y("n"), x("probe")).when(x("n") < y("n"), y("probe")).otherwise(x("probe") | y("probe"))
    sizes = (5 * F.least(x("n"), y("n"))) >= (4 * F.greatest(x("n"), y("n")))
    return sizes & ~(x("deleted") & y("deleted")) & ~(x("foreign") & y("foreign")) & probing & (x("comp") != y("comp"))


_MEMBER = ("node", "n", "deleted", "foreign", "probe", "answers", "comp")


def _as(prefix: str) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in _MEMBER]


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """Membership (doc_id, node, n, comp) of every row of ``docs(doc_id, text)`` and the links (a, b) found between nodes.

    Nodes are sets; comp is a node of the component.  Links join all nodes that
    are connected by similar pairs, though not every similar pair within a
    component is listed.  The third value is what ``few_files`` gives for tables made of these.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    path = fresh_path(spark, "shared-keys")
    entries = docs.mapInArrow(_entries, _ENTRY)
    dealt = F.when(F.col("tag") < 0, F.col("node")).otherwise(F.col("key"))  # the rows of documents with equal sets needn't meet
    entries = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt).sortWithinPartitions("key", "node", "tag")
    entries.mapInArrow(_shared_keys, f"{_ENTRY}, c long").write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffle's files
    files = few_files(spark, path)
    found = spark.read.schema(f"{_ENTRY}, c long").parquet(path)
    members = found.filter("tag < 0").select(F.col("node").alias("doc_id"), F.col("key").alias("node"), (-1 - F.col("tag")).alias("n"), "sketch")
    sketches = members.filter("n >= 4").select("node", "sketch")
    members = members.drop("sketch")
    nodes = staged(members.filter("n >= 4").groupBy("node", "n").agg(F.min("doc_id").alias("rep")).mapInArrow(_needs, "node long, n int, rep long, need int, capacity int, units int"), "nodes", files)

    by_node, by_segment = Window.partitionBy("node"), Window.partitionBy("node", "segment")
    own = (
        found.filter("tag >= 0").drop("sketch").join(nodes.drop("rep"), "node")
        .withColumn("foreign", F.col("tag").bitwiseAND(2) != 0)
        .withColumn("deleted", F.col("tag").bitwiseAND(1) != 0)
        .withColumn("segment", F.when(F.col("foreign"), -1).otherwise(F.shiftright("tag", 3)))
        .withColumn("cost", F.sum(F.col("c") - 1).over(by_segment))
        .withColumn("place", F.dense_rank().over(by_node.orderBy("cost", "segment")))
        .withColumn("shared", F.size(F.collect_set(F.when(~F.col("foreign"), F.col("segment"))).over(by_node)))
        .withColumn("before", F.max(F.when(F.col("foreign"), F.col("place"))).over(by_node))
        .withColumn("central", F.sum(F.when(~F.col("foreign") & ~F.col("deleted"), F.floor(F.log2("c") * 1000))).over(by_node))
    )
    # segments that nobody shares are probed for free; the cheapest others make up the rest
    rank = F.col("place") - F.when(F.col("before") < F.col("place"), 1).otherwise(0)
    missing = F.col("need") - (F.col("capacity") - F.col("units") * F.col("shared"))
    entries = own.select(
        "key", "node", "n", "foreign", "deleted", (F.col("foreign") | (rank <= F.ceil(missing / F.col("units")))).alias("probe"), F.lit(True).alias("answers"),
        F.coalesce(F.floor(F.col("central") * F.col("units") / F.col("capacity")), F.lit(0)).alias("central"),
    )

    comps: DataFrame | None = None
    links: DataFrame | None = None
    tested: DataFrame | None = None
    sets: DataFrame | None = None

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        return staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs", files)

    def compared(pairs: DataFrame) -> None:
        nonlocal tested
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            linked(verify(pairs, sets))

    def linked(new: DataFrame) -> None:
        nonlocal links
        new = staged(new, "links", files)
        links = new if links is None else links.union(new)

    def several(entries: DataFrame, *more) -> DataFrame:
        """Of the keys with several components, one of whose nodes asks: the key, ``more``, and how many may be compared with how many."""
        found = entries.groupBy("key").agg(
            F.bool_or("probe").alias("any"), F.min("comp").alias("one"), F.max("comp").alias("other"), F.least(F.count_if("probe"), F.count_if("answers")).alias("size"), *more
        )
        return found.filter("any and one < other").drop("any", "one", "other")

    for level in range(LEVELS + 1):
        first = level == 0
        entries = staged(with_components(entries, comps), "entries", files)
        hubs = several(entries, F.max(F.struct("central", *_MEMBER)).alias("hub"))
        hubs = staged(hubs.select("key", "hub.*").select("key", *_as("x_")), "hubs", files)
        if hubs.isEmpty():
            break
        if sets is None:
            sets = sets_of(entries.join(hubs.select("key"), "key", "left_semi").select("node"), nodes, docs, files)
        compared(candidates(hubs.join(entries.select("key", *_as("y_")), "key").filter(_pairs("x_", "y_", first))))
        comps = staged(components(links, files), "components", files) if links is not None else None
        rest = entries.drop("comp").join(hubs.select("key", F.col("x_node").alias("hub")), "key").filter("node != hub")
        rest = staged(with_components(rest, comps), "rest", files)
        sizes = staged(several(rest), "sizes", files)
        if sizes.isEmpty():
            break
        # small groups: all pairs of different components whose sketches don't differ by too much
        few = sizes.filter(F.col("size") <= SMALL) if level < LEVELS else sizes
        few = rest.join(few.select("key"), "key", "left_semi")
        drawn = staged(few.join(sketches.join(few.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node"), "drawn", files)
        ones, others = (drawn.select("key", *_as(p), F.col("sketch").alias(f"{p}sketch")) for p in ("x_", "y_"))
        alike = (F.col("x_node") < F.col("y_node")) & (_differing("x_sketch", "y_sketch") <= F.floor((F.col("x_n") + F.col("y_n")) / 9))
        compared(candidates(ones.join(others, "key").filter(_pairs("x_", "y_", first) & alike)))
        # large groups: smaller ones of members that share differences from the hub
        large = sizes.filter(F.col("size") > SMALL).select("key")
        if level == LEVELS or large.isEmpty():
            break
        family = rest.join(large, "key", "left_semi").select("hub", "node", "comp")
        of_hubs = with_components(family.select(F.col("hub").alias("node")).distinct(), comps)
        family = family.join(bounded_broadcast(of_hubs.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))), "hub")
        family = staged(family.groupBy("hub", "node").agg(F.bool_or(F.col("comp") != F.col("hub_comp")).alias("apart")), "family", files)
        new, entries = delta_entries(family, sets, files)
        linked(new)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
        return members.withColumn("comp", F.col("node")), links, files
    return with_components(members, staged(components(links, files), "components", files)).select("doc_id", "node", "n", "comp"), links, files


def _differing(one: str, other: str) -> Column:
    """The number of bits in which two sketches differ."""
    return sum((F.bit_count(F.get(F.col(one), F.lit(k)).bitwiseXOR(F.get(F.col(other), F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))


def with_components(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds the component of each node; a node without links is its own."""
    if comps is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Words are what lies between white space (space, tab to carriage return),
    A-Z in lower case; a document's set holds its 5-word shingles, with fewer
    words the whole sequence.  component_id is the smallest doc_id reachable by
    links of a Jaccard similarity of 0.8 or more.  Null and empty texts have an
    empty set and are linked with nothing: their component_id is their own id.
    Repeated rows are equal sets, so they link.  A null doc_id stays null and is
    never the smallest.  Further columns are ignored.
    """
    labelled, _, files = join(docs)
    full = labelled.filter("n > 0")
    names = staged(full.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "names", files)  # written, so that the join can split a large component
    return (
        full.join(names, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        .union(labelled.filter("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one with the smallest doc_id.

    Rows are told apart by id and text, so rows that repeat a doc_id with
    texts that are no near duplicates are decided each for itself.  A null doc_id
    comes after all others.  Rows of empty sets all stay.
    """
    keyed = docs.withColumn("__row", row_key())
    labelled, _, files = join(keyed.select(F.col("__row").alias("doc_id"), "text"))
    found = labelled.filter("n > 0").groupBy(F.col("doc_id").alias("__row")).agg(F.min("comp").alias("comp"), F.count(F.lit(1)).alias("n"))
    found = staged(found.join(keyed.select("__row", "doc_id").distinct(), "__row"), "classes", files)
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row")).select("__row")
    first = staged(first, "first", files)
    others = bounded_broadcast(found.select("__row").join(bounded_broadcast(first), "__row", "left_anti"))
    kept = keyed.join(others, "__row", "left_anti")
    repeated = found.filter("n > 1").join(bounded_broadcast(first), "__row", "left_semi").select("__row")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    repeated = bounded_broadcast(repeated)
    once = kept.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.join(repeated, "__row", "left_anti").select(*docs.columns).union(once.select(*docs.columns))
