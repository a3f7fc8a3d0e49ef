"""Smoothing of label boundaries along the corridor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.config import GroundConfig

KEY = ["scene_id", "side"]


def placed(points: DataFrame, c: GroundConfig) -> DataFrame:
    """Points with s and lateral, with their side, corridor limit, s bin ``si``, number of s bins ``n_s`` and x bin ``xi``; sides without labelled terrain and points beyond the limit go."""
    ends = points.groupBy("scene_id").agg(F.min("s").alias("s_lo"), F.max("s").alias("__s1"))
    res, bin_size = c.curve_resolution, c.graph_x_bin
    n_s = F.greatest(F.lit(4), F.ceil((F.col("__s1") - F.col("s_lo")) / res)).cast("int")
    out = points.join(ends, "scene_id").withColumn("n_s", n_s).drop("__s1")
    out = out.withColumn("side", F.when(F.col("lateral") >= 0, 1).otherwise(-1)).withColumn("xa", F.abs("lateral"))
    marked = F.col("label").isin(c.embankment_label, c.ditch_label)
    widest = out.filter(marked).groupBy(*KEY).agg(F.max("xa").alias("__x"))
    out = out.join(widest, KEY).filter(F.col("xa") <= F.greatest(F.col("__x") + 3 * bin_size, F.lit(c.distance_limit + bin_size))).drop("__x")
    si = F.greatest(F.lit(0), F.least(F.col("n_s") - 1, F.floor((F.col("s") - F.col("s_lo")) / res))).cast("int")
    return out.withColumn("si", si).withColumn("xi", F.floor(F.col("xa") / bin_size).cast("int"))


def label_grid(points: DataFrame, c: GroundConfig) -> DataFrame:
    """Counts by (scene, side, si, xi), and the winner: ditch if no rarer than the others, else embankment if no rarer than ground, else ground."""
    of = lambda label: F.count(F.when(F.col("label") == label, 1))
    cells = points.groupBy(*KEY, "n_s", "si", "xi").agg(of(c.ground_label).alias("n_ground"), of(c.embankment_label).alias("n_emb"), of(c.ditch_label).alias("n_ditch"), F.count(F.lit(1)).alias("n_total"))
    ditch = (F.col("n_ditch") > 0) & (F.col("n_ditch") >= F.col("n_ground")) & (F.col("n_ditch") >= F.col("n_emb"))
    emb = (F.col("n_emb") > 0) & (F.col("n_emb") >= F.col("n_ground"))
    return cells.withColumn("cell", F.when(ditch, c.ditch_label).when(emb, c.embankment_label).otherwise(c.ground_label))


def boundaries(grid: DataFrame, c: GroundConfig) -> DataFrame:
    """emb_outer, ditch_inner, ditch_outer (null: unknown) and edge_locked by (scene, side, si), one row for every s bin of a side."""
    middle = (F.col("xi") + 0.5) * c.graph_x_bin
    x = lambda label: F.when(F.col("cell") == label, middle)
    rows = grid.groupBy(*KEY, "si").agg(
        F.max(middle).alias("__all"), F.max(x(c.embankment_label)).alias("__e"), F.min(x(c.ditch_label)).alias("__i"), F.max(x(c.ditch_label)).alias("__o")
    )
    limit = F.col("__all") - c.graph_x_bin
    free = lambda outer, value: F.when(F.col(outer) < limit, F.col(value))
    rows = rows.select(
        *KEY, "si", free("__e", "__e").alias("emb_outer"), free("__o", "__i").alias("ditch_inner"), free("__o", "__o").alias("ditch_outer"),
        F.coalesce((F.col("__e") >= limit), F.lit(False)).__or__(F.coalesce(F.col("__o") >= limit, F.lit(False))).alias("edge_locked"),
    )
    every = grid.select(*KEY, "n_s").distinct().select(*KEY, F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)).alias("si"))
    return every.join(rows, [*KEY, "si"], "left").withColumn("edge_locked", F.coalesce("edge_locked", F.lit(False)))


def filled(curves: DataFrame, name: str) -> Column:
    """A curve with its gaps on the line between the neighbours, and level beyond the first and last known value."""
    order = Window.partitionBy(*KEY).orderBy("si")
    known = F.when(F.col(name).isNotNull(), F.struct("si", F.col(name).alias("v")))
    left = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    between = left["v"] + (F.col("si") - left["si"]) * (right["v"] - left["v"]) / F.nullif(right["si"] - left["si"], F.lit(0))
    return F.when(F.col(name).isNotNull(), F.col(name)).when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(between)


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at four sigmas, that sum to 1."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(values: Column, sigma: float) -> Column:
    """An array smoothed by a Gaussian, its ends repeated."""
    weights = kernel(sigma)
    radius, table = len(weights) // 2, F.array(*map(F.lit, weights))
    at = lambda i: F.get(values, F.greatest(F.lit(0), F.least(F.size(values) - 1, i)))
    one = lambda i: F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda total, k: total + F.get(table, k + radius) * at(i + k))
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), one)


def smooth_curves(curves: DataFrame, c: GroundConfig) -> DataFrame:
    """The five smoothed curves by (scene, side, si), each with its next value; sides with under two embankment rows go."""
    flag = lambda name: F.when(F.col(name).isNotNull(), 1.0).otherwise(0.0)
    names = ["emb_outer", "ditch_inner", "ditch_outer"]
    full = curves.select(*KEY, "si", "edge_locked", *names, *(filled(curves, n).alias(f"f_{n}") for n in names))
    listed = full.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("si", "edge_locked", *names, *(f"f_{n}" for n in names), flag("emb_outer").alias("emb_on"), flag("ditch_outer").alias("ditch_on")))).alias("r"),
        F.count("emb_outer").alias("n_emb"), F.count("ditch_outer").alias("n_ditch"),
    ).filter("n_emb >= 2")
    sigma = c.smooth_level / c.curve_resolution
    take = lambda name: F.transform("r", lambda v: v[name])
    either = lambda name: F.when(F.col("n_ditch") >= 2, gaussian(take(f"f_{name}"), sigma)).otherwise(take(name))
    out = listed.select(
        *KEY, F.col("r.si").alias("si"), F.col("r.edge_locked").alias("edge_locked"), gaussian(take("f_emb_outer"), sigma).alias("emb"),
        either("ditch_inner").alias("inner"), either("ditch_outer").alias("outer"), gaussian(take("emb_on"), sigma).alias("emb_on"), gaussian(take("ditch_on"), sigma).alias("ditch_on"),
    )
    rows = out.select(*KEY, F.explode(F.arrays_zip("si", "edge_locked", "emb", "inner", "outer", "emb_on", "ditch_on")).alias("z")).select(*KEY, "z.*")
    order = Window.partitionBy(*KEY).orderBy("si")
    return rows.select("*", *(F.lead(n).over(order).alias(f"{n}_1") for n in ("emb", "inner", "outer", "emb_on", "ditch_on")))


def smooth_labels(points: DataFrame, curves: DataFrame, c: GroundConfig) -> DataFrame:
    """scene_id, point_id, new_label of the placed points whose s bin isn't locked.

    Curves are read between bin middles, level beyond the first and last; an
    unknown boundary holds no point.
    """
    middles = (F.col("s") - F.col("s_lo")) / c.curve_resolution - 0.5
    j = F.greatest(F.lit(0), F.least(F.col("n_s") - 2, F.floor(middles))).cast("int")
    at = points.withColumn("__m", middles).withColumn("__j", j)
    at = at.withColumn("__t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__m") - F.col("__j"))))
    locks = curves.select(*KEY, F.col("si"), "edge_locked")
    lines = curves.withColumnRenamed("si", "__j").drop("edge_locked")
    found = at.join(lines, [*KEY, "__j"]).join(locks, [*KEY, "si"]).filter(~F.col("edge_locked"))
    # a value of weight 0 doesn't count, known or not
    value = lambda n: F.when(F.col("__t") == 0, F.col(n)).when(F.col("__t") == 1, F.col(f"{n}_1")).otherwise(F.col(n) + F.col("__t") * (F.col(f"{n}_1") - F.col(n)))
    ditch = (value("ditch_on") > 0.3) & (F.col("xa") > value("inner")) & (F.col("xa") <= value("outer"))
    emb = (value("emb_on") > 0.3) & (F.col("xa") <= value("emb"))
    return found.select("scene_id", "point_id", F.when(ditch, c.ditch_label).when(emb, c.embankment_label).otherwise(c.ground_label).alias("new_label"))
