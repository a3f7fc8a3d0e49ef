"""Voxels, tiles and raster cells of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subsample(points: DataFrame, size: float) -> DataFrame:
    """Of each scene's xyz voxel the point nearest to its middle, ties to the lowest point_id: scene_id, point_id."""
    key = {a: F.floor(F.col(a) / size) for a in "xyz"}
    off = {a: F.col(a) - (key[a] + 0.5) * size for a in "xyz"}
    d2 = off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"]
    return points.groupBy("scene_id", *(key[a].alias(f"k{a}") for a in "xyz")).agg(F.min(F.struct(d2.alias("d2"), "point_id"))["point_id"].alias("point_id")).select("scene_id", "point_id")


def max_z(points: DataFrame, cell: float) -> DataFrame:
    """The highest z of each raster cell: scene_id, iy, ix, z; cells count from the scene's least x and y."""
    start = points.groupBy("scene_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = lambda a: F.floor((F.col(a) - F.col(f"{a}0")) / cell).cast("int")
    return points.join(start, "scene_id").groupBy("scene_id", at("y").alias("iy"), at("x").alias("ix")).agg(F.max("z").alias("z"))


def tiles(points: DataFrame, size: float, overlap: float, least: int) -> DataFrame:
    """(scene_id, point_id, ty, tx) for every tile that a point lies in; tiles overlap on each side, and those of under ``least`` points go."""
    start = points.groupBy("scene_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"))
    placed = points.join(start, "scene_id")

    def of(a: str):
        u = F.col(a) - F.col(f"{a}0")
        last = F.floor((F.col(f"{a}9") - F.col(f"{a}0")) / size)
        low = F.greatest(F.lit(0).cast("long"), F.floor((u - overlap) / size))
        # half open: a tile k holds k * size - overlap <= u < (k + 1) * size + overlap
        low = F.when(u >= (low + 1) * size + overlap, low + 1).otherwise(low)
        return F.explode(F.sequence(low, F.greatest(low, F.least(last, F.floor((u + overlap) / size)))))

    spread = placed.withColumn("tx", of("x")).withColumn("ty", of("y")).select("scene_id", "point_id", "ty", "tx")
    full = spread.groupBy("scene_id", "ty", "tx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    return spread.join(full, ["scene_id", "ty", "tx"], "left_semi")


def plot_parts(profile: DataFrame, keys: list[str], max_gap: float | None = None) -> DataFrame:
    """Adds part: profiles broken where x leaps by more than ``max_gap``, or three times the median gap."""
    order = Window.partitionBy(*keys).orderBy("x")
    stepped = profile.withColumn("gap", F.col("x") - F.lag("x").over(order)).filter("gap is null or gap > 1e-9")
    limit = F.lit(max_gap) if max_gap else F.greatest(3 * F.median("gap").over(Window.partitionBy(*keys)), F.lit(1e-6))
    marked = stepped.withColumn("leap", F.when(F.col("gap") > limit, 1).otherwise(0))
    return marked.withColumn("part", F.sum("leap").over(order)).drop("gap", "leap")


def outliers_kept(distances: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Of (scene_id, point_id, mean_distance) to a point's neighbours the rows within the scene's mean and ``ratio`` deviations."""
    limits = distances.groupBy("scene_id").agg((F.avg("mean_distance") + ratio * F.stddev("mean_distance")).alias("limit"))
    return distances.join(limits, "scene_id").filter(F.col("mean_distance") <= F.col("limit")).select("scene_id", "point_id")
