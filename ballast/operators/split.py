"""Profiles into embankment, ditch and rest, by runs of slope.

Every bin knows where the run that it lies in ends, so the first run of at least
``m`` bins from ``lo`` on and within ``hi`` begins at the least ``i >= lo`` with
``i + m <= hi`` and ``end - i >= m``.  All steps use one partitioning by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.config import DitchConfig, GroundConfig
from ballast.operators.profile import SECTION, SIDE


def _side():
    return Window.partitionBy(*SIDE)


def runs(profile: DataFrame, slope: float) -> DataFrame:
    """Adds stop_end, up_end and down_end: where the run of bins that don't fall, that rise and that fall ends (i itself outside of one)."""
    ahead = Window.partitionBy(*SIDE).orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    masks = {"stop": F.col("dz") >= -slope, "up": F.col("dz") > slope, "down": F.col("dz") < -slope}
    for name, mask in masks.items():
        profile = profile.withColumn(f"{name}_end", F.coalesce(F.min(F.when(~F.coalesce(mask, F.lit(False)), F.col("i"))).over(ahead), F.col("len")))
    return profile


def first_run(kind: str, lo: Column, hi: Column, least: int) -> Column:
    """(i, end) of the side's first run as above, where end is the run's true end; null if there is none."""
    fits = (F.col("i") >= lo) & (F.col("i") + least <= hi) & (F.col(f"{kind}_end") - F.col("i") >= least)
    return F.min(F.when(fits, F.struct(F.col("i"), F.col(f"{kind}_end").alias("end")))).over(_side())


def embankment_end(profile: DataFrame, c: GroundConfig) -> DataFrame:
    """Adds emb_end: the first place, past the least embankment and the noise, where it stops falling for long enough; null if nowhere."""
    least = c.points(c.graph_min_embankment_m)
    origin = max(c.graph_noise_points, least)
    return profile.withColumn("emb_end", first_run("stop", F.lit(origin), F.col("len"), c.points(c.graph_embankment_min_stop_m))["i"])


def ditch_interval(profile: DataFrame, c: GroundConfig) -> DataFrame:
    """Adds search_start, search_stop, ditch_start and ditch_end (null without a ditch)."""
    up, down = c.points(c.graph_ditch_min_uphill_m), c.points(c.graph_ditch_min_downhill_m)
    near, flat, longest = c.points(c.graph_ditch_immediate_points_m, 0), c.points(c.graph_ditch_max_flat_m, 0), c.points(c.graph_ditch_max_uphill_m)
    start, stop = F.col("search_start"), F.col("search_stop")
    from_rail = F.col("out_x") - F.col("__x0")
    out = (
        profile.withColumn("__x0", F.min("out_x").over(_side()))
        .withColumn("search_start", F.count(F.when(from_rail < c.graph_ditch_search_min_m, 1)).over(_side()))
        .withColumn("search_stop", F.greatest("search_start", F.count(F.when(from_rail <= c.graph_ditch_search_max_m, 1)).over(_side())))
    )
    capped = lambda run: F.least(stop, F.least(F.col(f"{run}.end"), F.col(f"{run}.i") + longest))
    begin = F.greatest("emb_end", "search_start")
    out = out.withColumn("__near", first_run("up", begin, F.least(stop, begin + near + up), up)).withColumn("__up", first_run("up", start, stop, up)).withColumn("__down", first_run("down", start, stop, down))
    bottom = F.least(stop, F.col("__down.end"))
    out = out.withColumn("__rise", F.when(F.col("__down").isNotNull(), first_run("up", bottom, F.least(stop, bottom + flat + up), up)))
    # right behind the embankment; else the earlier of a fall with a rise behind it, and a rise alone
    immediate = F.col("emb_end").isNotNull() & (begin < stop) & F.col("__near").isNotNull() & (F.col("__near.i") - begin <= near)
    fall = F.when(F.col("__rise").isNotNull(), F.struct(F.col("__down.i").alias("i"), F.lit(0).alias("kind"), capped("__rise").alias("end")))
    rise = F.when(F.col("__up").isNotNull(), F.struct(F.col("__up.i").alias("i"), F.lit(1).alias("kind"), capped("__up").alias("end")))
    out = out.withColumn("__far", F.array_min(F.array_compact(F.array(fall, rise))))
    # a ditch right behind the embankment may begin before its end, another may not
    first = F.when(immediate, F.greatest(start, F.col("__near.i") - near)).otherwise(F.greatest(F.col("__far.i"), F.col("emb_end"), start))
    end = F.least(F.when(immediate, capped("__near")).otherwise(F.col("__far.end")), stop, F.col("len"))
    valid = F.col("emb_end").isNotNull() & (start < stop) & end.isNotNull() & (end > first) & (immediate | F.col("__far").isNotNull())
    out = out.withColumn("ditch_start", F.when(valid, first)).withColumn("ditch_end", F.when(valid, end))
    return out.drop("__x0", "__near", "__up", "__down", "__rise", "__far")


def split_ground(profile: DataFrame, c: GroundConfig) -> DataFrame:
    """Adds kind to every bin: emb, ditch or rest; sides of a single bin go."""
    i = F.col("i")
    kind = (
        F.when(F.col("emb_end").isNull(), "emb")
        .when(F.col("ditch_start").isNull(), F.when(i < F.col("emb_end"), "emb").otherwise("rest"))
        .when(i < F.col("ditch_start"), "emb").when(i < F.col("ditch_end"), "ditch").otherwise("rest")
    )
    found = ditch_interval(embankment_end(runs(profile, c.graph_uphill_slope), c), c)
    return found.filter("len >= 2").withColumn("kind", kind)


def split_ditch(profile: DataFrame, c: DitchConfig) -> DataFrame:
    """Adds kind: ditch from the start of the first long rise that ends behind the noise to its end, else rest."""
    found = runs(profile, c.graph_uphill_slope)
    is_start = (F.col("up_end") - F.col("i") >= c.graph_min_uphill_points) & (F.col("up_end") > c.graph_noise_points)
    rise = F.min(F.when(is_start, F.struct("i", F.col("up_end").alias("end")))).over(_side())
    found = found.withColumn("__rise", rise)
    inside = F.col("__rise").isNotNull() & (F.col("i") < F.col("__rise.end")) & (F.col("i") >= F.lit(0))
    return found.withColumn("kind", F.when(inside, "ditch").otherwise("rest")).drop("__rise")


def intervals(split: DataFrame) -> DataFrame:
    """scene_id, section_id, side, kind, x_min, x_max."""
    return split.groupBy(*SIDE, "kind").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def in_any(found: str, kind: str, pad: float) -> Column:
    """Does rx lie in some interval of the kind, ends and half a bin beyond them included?"""
    return F.exists(found, lambda v: (v["kind"] == kind) & (F.col("rx") >= v["x_min"] - pad) & (F.col("rx") <= v["x_max"] + pad))


def section_labels(points: DataFrame, found: DataFrame, bin_size: float, emb: int, ditch: int, ground: int) -> DataFrame:
    """Adds new_label to the points of sections that have intervals: ditch, else embankment (also between two), else ground, else as it was."""
    pad = bin_size / 2
    by_section = found.groupBy(*SECTION).agg(F.collect_list(F.struct("side", "kind", "x_min", "x_max")).alias("__iv"))
    embs = F.filter("__iv", lambda v: v["kind"] == "emb")
    both = F.exists(embs, lambda v: v["side"] < 0) & F.exists(embs, lambda v: v["side"] > 0)
    between = both & (F.col("rx") >= F.array_min(F.transform(embs, lambda v: v["x_min"])) - pad) & (F.col("rx") <= F.array_max(F.transform(embs, lambda v: v["x_max"])) + pad)
    label = (
        F.when(in_any("__iv", "ditch", pad), ditch).when(in_any("__iv", "emb", pad) | between, emb)
        .when(in_any("__iv", "rest", pad), ground).otherwise(F.col("label"))
    )
    return points.join(by_section, SECTION).withColumn("new_label", label.cast("int")).drop("__iv")
