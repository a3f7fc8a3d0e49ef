"""X-Z profiles of sections: bins, sides, gap filling, smoothing, gradient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.units import steady_mean

SECTION = ["scene_id", "section_id"]
SIDE = [*SECTION, "side"]


def xz_profile(points: DataFrame, bin_size: float, is_rail: Column) -> DataFrame:
    """scene_id, section_id, bin, x (the bin's middle), z (mean), n, rail (does any rail point lie in it)."""
    start = points.groupBy(*SECTION).agg(F.min("rx").alias("x0"))
    binned = points.join(start, SECTION).withColumn("bin", F.floor((F.col("rx") - F.col("x0")) / bin_size))
    return binned.groupBy(*SECTION, "x0", "bin").agg(steady_mean("z").alias("z"), F.count(F.lit(1)).alias("n"), F.bool_or(is_rail).alias("rail")).select(
        *SECTION, "bin", (F.col("x0") + (F.col("bin") + 0.5) * bin_size).alias("x"), "z", "n", "rail"
    )


def zx_profile(points: DataFrame, bin_size: float) -> DataFrame:
    """The other way round: scene_id, section_id, bin, z (the bin's middle), x (mean), n, in bins of height."""
    start = points.groupBy(*SECTION).agg(F.min("z").alias("z0"))
    binned = points.join(start, SECTION).withColumn("bin", F.floor((F.col("z") - F.col("z0")) / bin_size))
    return binned.groupBy(*SECTION, "z0", "bin").agg(F.avg("rx").alias("x"), F.count(F.lit(1)).alias("n")).select(
        *SECTION, "bin", (F.col("z0") + (F.col("bin") + 0.5) * bin_size).alias("z"), "x", "n"
    )


def split_by_rail(profile: DataFrame) -> DataFrame:
    """The bins left of the first rail bin (side -1) and right of the last (side 1), with i counted outward from the rail; sections without rail bins go."""
    section = Window.partitionBy(*SECTION)
    marked = profile.withColumn("lo", F.min(F.when(F.col("rail"), F.col("bin"))).over(section)).withColumn("hi", F.max(F.when(F.col("rail"), F.col("bin"))).over(section))
    sided = marked.withColumn("side", F.when(F.col("bin") < F.col("lo"), -1).when(F.col("bin") > F.col("hi"), 1)).filter("side is not null")
    return sided.drop("lo", "hi", "rail").withColumn("out_x", F.col("side") * F.col("x"))


def fill_gaps(sides: DataFrame) -> DataFrame:
    """All bins from each side's first to its last; the z of missing ones lies on the line between their neighbours."""
    side = Window.partitionBy(*SIDE).orderBy("bin")
    step = F.col("next_bin") - F.col("bin")
    grown = sides.withColumn("next_bin", F.coalesce(F.lead("bin").over(side), F.col("bin") + 1)).withColumn("next_z", F.lead("z").over(side)).withColumn("next_x", F.lead("x").over(side))
    grown = grown.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), step - 1)))
    t = F.col("j") / step
    at = lambda c: F.when(F.col("j") == 0, F.col(c)).otherwise(F.col(c) + t * (F.col(f"next_{c}") - F.col(c)))
    return grown.select(*SIDE, (F.col("bin") + F.col("j")).alias("bin"), at("x").alias("x"), at("z").alias("z"), F.when(F.col("j") == 0, F.col("n")).otherwise(0).alias("n")).withColumn("out_x", F.col("side") * F.col("x"))


def ordered(sides: DataFrame) -> DataFrame:
    """Adds i, the place outward from the rail, and the number of bins of the side; bins at a repeated distance go."""
    side = Window.partitionBy(*SIDE).orderBy("out_x", "bin")
    kept = sides.withColumn("gap", F.col("out_x") - F.lag("out_x").over(side)).filter("gap is null or gap > 1e-9").drop("gap")
    return kept.withColumn("i", F.row_number().over(side) - 1).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*SIDE)))


def moving_mean(profile: DataFrame, window: int, keys: list[str] = SIDE) -> DataFrame:
    """Adds ``zs``: the mean of ``window`` values around each, the first and last value repeated beyond the ends.

    Only for windows of 3 or more and profiles at least as long; an even window is widened by one.
    """
    if window < 3:
        return profile.withColumn("zs", F.col("z"))
    width = window + 1 - window % 2
    half = width // 2
    order = Window.partitionBy(*keys).orderBy("i")
    around = order.rowsBetween(-half, half)
    whole = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(F.lit(0), half - F.col("i")), F.greatest(F.lit(0), F.col("i") + half - (F.col("len") - 1))
    total = F.sum("z").over(around) + before * F.first("z").over(whole) + after * F.last("z").over(whole)
    return profile.withColumn("zs", F.when(F.col("len") >= window, total / width).otherwise(F.col("z")))


def gradient(profile: DataFrame, keys: list[str] = SIDE, x: str = "out_x", z: str = "zs") -> DataFrame:
    """Adds ``dz``: the derivative by x, one-sided at the ends, weighted by the gaps inside; null for a single value."""
    order = Window.partitionBy(*keys).orderBy("i")
    hs, hd = F.col(x) - F.lag(x).over(order), F.lead(x).over(order) - F.col(x)
    back, ahead = F.lag(z).over(order), F.lead(z).over(order)
    inner = (hs * hs * ahead + (hd * hd - hs * hs) * F.col(z) - hd * hd * back) / (hs * hd * (hs + hd))
    value = F.when(hs.isNull(), (ahead - F.col(z)) / hd).when(hd.isNull(), (F.col(z) - back) / hs).otherwise(inner)
    return profile.withColumn("dz", value)
