"""Track geometry: WKT decoding, selection by bounding box, densification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_wkt(tracks: DataFrame) -> DataFrame:
    """scene_id, track_id, part, seq, x, y of all LINESTRING and MULTILINESTRING geometries of ``tracks(scene_id, track_id, wkt)``; others are dropped."""
    shape = F.upper(F.trim(F.regexp_extract("wkt", r"^\s*([A-Za-z]+)", 1)))
    parts = F.regexp_extract_all(F.col("wkt"), F.lit(r"\(([^()]+)\)"), 1)
    lines = tracks.filter(shape.isin("LINESTRING", "MULTILINESTRING")).select("scene_id", "track_id", F.posexplode(parts).alias("part", "body"))
    vertices = lines.select("scene_id", "track_id", "part", F.posexplode(F.split(F.trim("body"), r"\s*,\s*")).alias("seq", "xy"))
    numbers = F.split(F.trim("xy"), r"\s+")
    return vertices.select("scene_id", "track_id", "part", "seq", numbers[0].cast("double").alias("x"), numbers[1].cast("double").alias("y"))


def bounding_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("scene_id").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of each line, with the length up to the first (d0) and the second (d1) and whether it is the last."""
    line = Window.partitionBy("scene_id", "track_id", "part").orderBy("seq")
    ends = vertices.withColumn("x1", F.lead("x").over(line)).withColumn("y1", F.lead("y").over(line)).filter("x1 is not null")
    length = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    return (
        ends.withColumn("len", length)
        .withColumn("d1", F.sum("len").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("d0", F.coalesce(F.lag("d1").over(line), F.lit(0.0)))
        .withColumn("is_last", F.lead("seq").over(line).isNull())
    )


def touches_box(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Does the segment meet the rectangle (x_min, x_max, y_min, y_max)?  Clipping of the parameter interval, axis by axis."""
    x_min, x_max, y_min, y_max = box
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for a, b, lo, hi in ((x0, x1, x_min, x_max), (y0, y1, y_min, y_max)):
        step = F.nullif(b - a, F.lit(0.0))
        t0, t1 = (lo - a) / step, (hi - a) / step
        low = F.greatest(low, F.least(t0, t1))  # greatest and least skip nulls
        high = F.least(high, F.greatest(t0, t1))
        outside = outside | ((b == a) & ((a < lo) | (a > hi)))
    return ~outside & (low <= high)


def select_tracks(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """All vertices of the tracks of which some segment meets the bounding box of the scene's points."""
    boxed = segments(vertices).join(bounding_boxes(points), "scene_id")
    box = tuple(F.col(c) for c in ("x_min", "x_max", "y_min", "y_max"))
    hit = boxed.filter(touches_box(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), box)).select("scene_id", "track_id").distinct()
    return vertices.join(hit, ["scene_id", "track_id"], "left_semi")


def densify(vertices: DataFrame, step: float) -> DataFrame:
    """scene_id, track_id, part, k, rx, ry: points every ``step`` along each line, and its end point.

    Sample k lies at ``min(k * step, length)`` for k up to ``ceil(length / step)``;
    each segment makes its own samples, so lines of any length spread over tasks.
    """
    first = F.ceil(F.col("d0") / step)
    last = F.when(F.col("is_last"), F.ceil(F.col("d1") / step)).otherwise(F.ceil(F.col("d1") / step) - 1)
    samples = segments(vertices).withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = F.least((F.least(F.col("k") * step, F.col("d1")) - F.col("d0")) / F.nullif("len", F.lit(0.0)), F.lit(1.0))
    t = F.coalesce(t, F.lit(0.0))
    return samples.select(
        "scene_id", "track_id", "part", "k", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("rx"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("ry")
    )
