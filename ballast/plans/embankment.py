"""The embankment segmenter: a raster mask grown from the tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.config import EmbankmentConfig
from ballast.operators import proximity, raster, tracks, voxel
from ballast.storage import bounded_broadcast, staged

#: Scenes of up to so many voxels are one tile; larger ones are cut into overlapping tiles.
TILE_POINTS = 2_000_000


def grown(points: DataFrame, c: EmbankmentConfig) -> DataFrame:
    """scene_id, point_id, found of ``points(scene_id, point_id, x, y, z, is_rail)``.

    Tiles are independent: all grow from the tracks, and a point is found if
    any tile finds it.  The overlap is wider than the mask can grow.  Tiles of
    few points are searched too: what is left out here would vote as not found.
    """
    sizes = bounded_broadcast(staged(points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")), "scene-sizes"))
    sized = points.join(sizes, "scene_id")
    whole = sized.filter(F.col("n") <= TILE_POINTS).withColumn("ty", F.lit(0).cast("long")).withColumn("tx", F.lit(0).cast("long"))
    large = sized.filter(F.col("n") > TILE_POINTS)
    cut = large.join(voxel.tiles(large, c.tile_size, c.tile_overlap, 1), ["scene_id", "point_id"])

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        found = raster.embankment(rows[["x", "y", "z"]].to_numpy(), rows["is_rail"].to_numpy(), c)
        return pd.DataFrame({"scene_id": rows["scene_id"], "point_id": rows["point_id"], "found": found})

    every = whole.unionByName(cut.select(*whole.columns)).groupBy("scene_id", "ty", "tx").applyInPandas(tile, "scene_id long, point_id long, found boolean")
    return every.groupBy("scene_id", "point_id").agg(F.bool_or("found").alias("found"))


def knn_vote(queries: DataFrame, known: DataFrame, c: EmbankmentConfig) -> DataFrame:
    """scene_id, point_id, found of ``queries(x, y, z)`` by a weighted vote of their k nearest ``known(x, y, z, found)``.

    Weights fall with the distance as a Gaussian, those of found points count
    ``class_weight`` times, and a tie is not found.  Neighbours are looked for
    within a growing radius by grid cells; a query is done when k lie within
    it, or when it reaches the weight's end, beyond which weights are 0.
    """
    radius, end = 2 * c.knn_sigma, 39 * c.knn_sigma  # exp(-39 ** 2 / 2) is 0 in double precision
    left, out = queries.select("scene_id", "point_id", "x", "y", "z"), None
    key = ["scene_id", "point_id"]
    while True:
        cell = lambda a: F.floor(F.col(a) / radius)  # noqa: E731,B023
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        asked = left.withColumn("cx", F.explode(F.transform(near, lambda d: cell("x") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: cell("y") + d))).withColumn("cz", F.explode(F.transform(near, lambda d: cell("z") + d)))
        stored = known.select("scene_id", F.col("point_id").alias("other"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("z").alias("kz"), "found", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
        d2 = (F.col("x") - F.col("kx")) ** 2 + (F.col("y") - F.col("ky")) ** 2 + (F.col("z") - F.col("kz")) ** 2
        pairs = asked.join(stored, ["scene_id", "cx", "cy", "cz"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
        ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("d2", "other"))).filter(F.col("nth") <= c.knn_k)
        weight = F.exp(-0.5 * F.col("d2") / c.knn_sigma**2)
        votes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("found"), weight).otherwise(0.0)).alias("w1"), F.sum(F.when(~F.col("found"), weight).otherwise(0.0)).alias("w0"))
        result = staged(left.join(votes, key, "left").select(*left.columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(c.class_weight * F.col("w1") > F.col("w0"), F.lit(False)).alias("found")), "votes")
        done = result if radius >= end else result.filter(F.col("n") >= c.knn_k)
        part = done.select(*key, "found")
        out = part if out is None else out.union(part)
        left = result.filter(F.col("n") < c.knn_k).select(*left.columns)
        if radius >= end or left.isEmpty():
            return out
        radius = min(2 * radius, end)


def segment_embankment(points: DataFrame, track_table: DataFrame, config: EmbankmentConfig = EmbankmentConfig()) -> DataFrame:
    """scene_id, point_id, label of every row of ``points(scene_id, point_id, x, y, z, label)``: ground points found become embankment.

    Scenes without rail points, or with nothing else, stay as they are.
    """
    c = config
    classes = points.filter(F.col("label").isin(c.ground_label, c.rail_label))
    dense = tracks.densify(tracks.select_tracks(tracks.decode_wkt(track_table), classes), 0.5).select("scene_id", "rx", "ry")
    rails = proximity.within(classes, dense, c.rail_radius, ["scene_id"]).select("scene_id", "point_id").withColumn("__r", F.lit(True))
    marked = classes.join(rails, ["scene_id", "point_id"], "left").withColumn("is_rail", F.coalesce("__r", F.lit(False)))
    origin = marked.groupBy("scene_id").agg(*(F.avg(a).alias(f"{a}0") for a in "xyz"), F.count_distinct("is_rail").alias("kinds")).filter("kinds = 2")
    origin = bounded_broadcast(staged(origin, "embankment-origin"))
    moved = [(F.col(a) - F.col(f"{a}0")).alias(a) for a in "xyz"]
    centred = staged(marked.join(origin, "scene_id").select("scene_id", "point_id", *moved, "is_rail", "label"), "embankment-points")
    kept = voxel.subsample(centred, c.voxel_size)
    sample = centred.join(kept, ["scene_id", "point_id"], "left_semi")
    found = staged(sample.join(grown(sample.drop("label"), c), ["scene_id", "point_id"], "left").withColumn("found", F.coalesce("found", F.lit(False))), "grown")
    rest = centred.join(found.select("scene_id", "point_id"), ["scene_id", "point_id"], "left_anti")
    voted = found.select("scene_id", "point_id", "found").union(knn_vote(rest, found, c))
    joined = points.join(voted, ["scene_id", "point_id"], "left")
    new = F.when(F.col("found") & (F.col("label") == c.ground_label), c.embankment_label).otherwise(F.col("label"))
    return joined.select("scene_id", "point_id", new.cast("smallint").alias("label"))
