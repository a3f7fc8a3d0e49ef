"""Cross-sections along a centerline: cuts, assignment of points, rotation, corridor, centring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.operators.centerline import nearest_vertex


def point_at(s, line_xy: np.ndarray, line_s: np.ndarray) -> np.ndarray:
    """The points at arc lengths ``s``; beyond the ends the first or last segment is prolonged."""
    s = np.atleast_1d(s)
    i = np.clip(np.searchsorted(line_s, s, side="right") - 1, 0, len(line_s) - 2)
    gap = line_s[i + 1] - line_s[i]
    t = np.where(gap == 0, 0.0, (s - line_s[i]) / np.where(gap == 0, 1.0, gap))
    return (1 - t)[:, None] * line_xy[i] + t[:, None] * line_xy[i + 1]


def curve_ratio(a, b, line_xy: np.ndarray, line_s: np.ndarray) -> np.ndarray:
    """Arc length over chord from a to b; infinite where the chord is zero."""
    a, b = np.atleast_1d(a), np.atleast_1d(b)
    chord = np.hypot(*(point_at(b, line_xy, line_s) - point_at(a, line_xy, line_s)).T)
    return np.where(chord == 0, np.inf, (b - a) / np.where(chord == 0, 1.0, chord))


def cut_end(s: float, line_xy, line_s, shortest: float, longest: float, step: float, most: float) -> float:
    """Where the section that begins at ``s`` ends: before the first stretch that bends too much, but not before the shortest length."""
    total = float(line_s[-1])
    end = min(s + longest, total)
    if end - s <= shortest:
        return end
    marks = np.arange(s, end, step)
    if marks[-1] != end:
        marks = np.append(marks, end)
    bad = np.flatnonzero((curve_ratio(marks[:-1], marks[1:], line_xy, line_s) > most) & (marks[1:] > marks[:-1]))
    if not len(bad):
        return end
    at = float(marks[bad[0]])
    return min(s + shortest, total) if at <= s + shortest else at


def cuts(line: DataFrame, shortest: float, longest: float, step: float, most: float) -> DataFrame:
    """scene_id, section_id, s0, s1, p0x, p0y, fx, fy: each cut begins where the one before ended, so a scene's small centerline is walked in order."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vtx")
        xy, at = rows[["cx", "cy"]].to_numpy(), rows["s"].to_numpy()
        out, s = [], 0.0
        while len(at) >= 2 and s < at[-1]:
            end = cut_end(s, xy, at, shortest, longest, step, most)
            p0, p1 = point_at([s, end], xy, at)
            norm = float(np.hypot(*(p1 - p0)))
            fx, fy = (p1 - p0) / norm if norm > 0 else (np.nan, np.nan)
            out.append((int(rows["scene_id"].iloc[0]), len(out), s, end, p0[0], p0[1], fx, fy))
            s = end
        return pd.DataFrame(out, columns=["scene_id", "section_id", "s0", "s1", "p0x", "p0y", "fx", "fy"]).dropna()

    return line.groupBy("scene_id").applyInPandas(walk, "scene_id long, section_id int, s0 double, s1 double, p0x double, p0y double, fx double, fy double")


def assign(points: DataFrame, line: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds the section with ``s0 <= point_s < s1`` and its frame; points at the last vertex are in none.

    A point's place is that of its nearest vertex, so vertices are put into
    sections, each by the last section that begins before it.
    """
    row = ("section_id", "s0", "s1", "p0x", "p0y", "fx", "fy")
    vertices = line.select("scene_id", F.col("s").alias("at"), F.lit(1).alias("kind"), F.struct("vtx", "cx", "cy", "s").alias("vertex"), F.lit(None).alias("own"))
    starts = sections.select("scene_id", F.col("s0").alias("at"), F.lit(0).alias("kind"), F.lit(None).alias("vertex"), F.struct(*row).alias("own"))
    so_far = Window.partitionBy("scene_id").orderBy("at", "kind", "own.section_id").rowsBetween(Window.unboundedPreceding, 0)
    held = starts.unionByName(vertices).withColumn("own", F.last("own", ignorenulls=True).over(so_far)).filter("vertex is not null")
    held = held.select("scene_id", "vertex.*", F.when(F.col("vertex.s") < F.col("own.s1"), F.col("own")).alias("__own"))
    placed = nearest_vertex(points, held, ["__own"]).filter("__own is not null")
    return placed.select("*", *(f"__own.{c}" for c in row)).drop("__own")


def rotate(assigned: DataFrame, centre_x: bool = False, margin: float = 0) -> DataFrame:
    """Adds ``rx`` (to the right of the section), ``ry`` (along it, from its first point) and, for ditches, centres rx between its extremes.

    With a margin other than 0, points go that lie further from the middle than
    half of the section's width and the margin: a negative one trims the sections.
    """
    dx, dy = F.col("x") - F.col("p0x"), F.col("y") - F.col("p0y")
    section = Window.partitionBy("scene_id", "section_id")
    out = assigned.withColumn("rx", dx * F.col("fy") - dy * F.col("fx")).withColumn("__a", dx * F.col("fx") + dy * F.col("fy"))
    out = out.withColumn("ry", F.col("__a") - F.min("__a").over(section)).drop("__a")
    if not (centre_x or margin):
        return out
    out = out.withColumn("__low", F.min("rx").over(section)).withColumn("__high", F.max("rx").over(section))
    middle = (F.col("__low") + F.col("__high")) * 0.5
    if margin:
        out = out.filter(F.abs(F.col("rx") - middle) <= (F.col("__high") - F.col("__low") + 2 * margin) * 0.5)
    return (out.withColumn("rx", F.col("rx") - middle) if centre_x else out).drop("__low", "__high")


def corridor(rotated: DataFrame, is_seed: Column, is_candidate: Column, radius: float) -> DataFrame:
    """The seeds, and the candidates nearer than ``radius`` to a seed of the same section.

    Grid buckets of the radius make this an equi-join on section and cell.
    """
    from ballast.operators.proximity import within

    seeds = rotated.filter(is_seed)
    targets = seeds.select("scene_id", "section_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    others = rotated.filter(~is_seed & is_candidate).withColumnRenamed("rx", "__rx").withColumnRenamed("ry", "__ry")
    near = within(others, targets, radius, ["scene_id", "section_id"], strict=True).withColumnRenamed("__rx", "rx").withColumnRenamed("__ry", "ry")
    return seeds.unionByName(near)


def centre_on_rail(points: DataFrame, is_rail: Column) -> DataFrame:
    """Moves rx so that the middle of the 5th and 95th percentile of the section's rail points is 0; sections without rail go."""
    ends = points.filter(is_rail).groupBy("scene_id", "section_id").agg(F.percentile("rx", F.array(F.lit(0.05), F.lit(0.95))).alias("__p"))
    return points.join(ends, ["scene_id", "section_id"]).withColumn("rx", F.col("rx") - (F.col("__p")[0] + F.col("__p")[1]) * 0.5).drop("__p")
