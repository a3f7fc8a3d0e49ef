"""Centerline of a corridor: voxel nodes, principal axis, bin medians, cubic fit, arc length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.units import steady_mean
from ballast.storage import bounded_broadcast, staged


def nodes(points: DataFrame, voxel: float) -> DataFrame:
    """One node per scene and xy voxel: the mean of its points."""
    key = lambda c: F.floor(F.col(c) / voxel)
    return points.groupBy("scene_id", key("x").alias("kx"), key("y").alias("ky")).agg(steady_mean("x").alias("nx"), steady_mean("y").alias("ny"))


def principal_axis(nodes: DataFrame) -> DataFrame:
    """scene_id, mx, my, fx, fy: the mean node and the axis of largest variance, with fx > 0 (or fy > 0 where fx is 0)."""
    means = nodes.groupBy("scene_id").agg(steady_mean("nx").alias("mx"), steady_mean("ny").alias("my"))
    dx, dy = F.col("nx") - F.col("mx"), F.col("ny") - F.col("my")
    moments = nodes.join(means, "scene_id").groupBy("scene_id", "mx", "my").agg(steady_mean(dx * dy).alias("sxy"), steady_mean(dx * dx).alias("sxx"), steady_mean(dy * dy).alias("syy"))
    angle = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    return moments.select("scene_id", "mx", "my", F.cos(angle).alias("fx"), F.sin(angle).alias("fy"))


def trace(nodes: DataFrame, axis: DataFrame, voxel: float, least: int = 3) -> DataFrame:
    """scene_id, bin, n, u, v: medians along and across the axis by bin; bins of under ``least`` nodes go, as do repeated u."""
    placed = nodes.join(axis, "scene_id").select(
        "scene_id",
        ((F.col("nx") - F.col("mx")) * F.col("fx") + (F.col("ny") - F.col("my")) * F.col("fy")).alias("u"),
        ((F.col("nx") - F.col("mx")) * F.col("fy") - (F.col("ny") - F.col("my")) * F.col("fx")).alias("v"),
    )
    start = placed.groupBy("scene_id").agg(F.min("u").alias("u0"))
    binned = placed.join(start, "scene_id").withColumn("bin", F.floor((F.col("u") - F.col("u0")) / voxel))
    medians = binned.groupBy("scene_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.median("u").alias("u"), F.median("v").alias("v")).filter(F.col("n") >= least)
    order = Window.partitionBy("scene_id").orderBy("u", "bin")
    return medians.withColumn("gap", F.col("u") - F.lag("u").over(order)).filter("gap is null or gap > 1e-9").drop("gap")


def fit_curve(u: np.ndarray, v: np.ndarray, voxel: float) -> tuple[np.ndarray, np.ndarray, str]:
    """A smooth curve v(u): the cubic of least squares if its squared residuals sum to no more than ``n * voxel^2 * 25``.

    Else cubic splines with 1, 2, 4 ... evenly spaced inner knots are tried
    until one does (at last the points themselves).  Under four points the
    points are returned as they are.
    """
    n = len(u)
    if n < 4:
        return u, v, "trace"
    allowed = n * voxel**2 * 25.0
    u_new = np.linspace(u[0], u[-1], max(n, int((u[-1] - u[0]) / voxel)))
    centre, scale = (u[0] + u[-1]) / 2, max((u[-1] - u[0]) / 2, 1e-9)
    knots = 0
    while True:
        inner = np.linspace(-1, 1, knots + 2)[1:-1]
        basis = lambda x: np.column_stack([*(x**k for k in range(4)), *(np.maximum(x - t, 0) ** 3 for t in inner)])
        a = basis((u - centre) / scale)
        weights, *_ = np.linalg.lstsq(a, v, rcond=None)
        if ((a @ weights - v) ** 2).sum() <= allowed:
            return u_new, basis((u_new - centre) / scale) @ weights, "cubic" if knots == 0 else f"spline{knots}"
        if knots + 4 >= n:
            return u, v, "trace"
        knots = max(1, 2 * knots)


def _curve(voxel: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("u")
        u, v, kind = fit_curve(rows["u"].to_numpy(), rows["v"].to_numpy(), voxel)
        mx, my, fx, fy = (float(rows[c].iloc[0]) for c in ("mx", "my", "fx", "fy"))
        cx, cy = mx + u * fx + v * fy, my + u * fy - v * fx
        s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(cx), np.diff(cy)))])
        kept = len(u) if s[-1] > 0 else 0
        return pd.DataFrame({"scene_id": rows["scene_id"].iloc[0], "vtx": np.arange(len(u), dtype=np.int32), "cx": cx, "cy": cy, "s": s, "fit_kind": kind}).head(kept)

    return build


def centerline(points: DataFrame, voxel: float) -> DataFrame:
    """scene_id, vtx, cx, cy, s, fit_kind from a band of points; one small group of bin medians per scene is fitted in numpy.

    A scene without any bin of three nodes, or with one vertex only, has no centerline.
    """
    found = staged(nodes(points, voxel), "nodes")
    axis = principal_axis(found)
    placed = trace(found, axis, voxel).join(axis, "scene_id")
    return placed.groupBy("scene_id").applyInPandas(_curve(voxel), "scene_id long, vtx int, cx double, cy double, s double, fit_kind string")


#: Sides of the cells, in metres, for which those parts of a line are found that can be the nearest.
CELLS = (64.0, 2.0)


def _near_cells(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Joins ``points(x, y)`` with ``line``: of the array of their scene in ``lines(scene_id, line)`` the elements whose (px, py) can be the nearest.

    For all points of a cell these are the elements no further from its middle
    than the nearest one and the cell's diagonal.  Coarse cells look at the whole
    line, fine ones at what is left for their coarse cell, points at the few
    left for their fine one; points are joined by scene and cell.
    """
    key = lambda c, side: F.floor(F.col(c) / side)
    cells = points.select("scene_id", key("x", CELLS[-1]).alias("__kx"), key("y", CELLS[-1]).alias("__ky")).distinct()
    cells = cells.withColumn("__gx", F.floor((F.col("__kx") + 0.5) * CELLS[-1] / CELLS[0])).withColumn("__gy", F.floor((F.col("__ky") + 0.5) * CELLS[-1] / CELLS[0]))

    def narrowed(side: float, kx: str, ky: str) -> Column:
        mx, my = (F.col(kx) + 0.5) * side, (F.col(ky) + 0.5) * side
        far = lambda v: F.sqrt((v["px"] - mx) * (v["px"] - mx) + (v["py"] - my) * (v["py"] - my))
        # bound by a lambda: as a column the optimizer puts it into the filter, where it is found anew for every element
        least = F.array(F.array_min(F.transform("line", far)))
        return F.get(F.transform(least, lambda m: F.filter("line", lambda v: far(v) <= m + side * 2**0.5 * (1 + 1e-9))), F.lit(0)).alias("line")

    coarse = cells.select("scene_id", "__gx", "__gy").distinct().join(lines, "scene_id").select("scene_id", "__gx", "__gy", narrowed(CELLS[0], "__gx", "__gy"))
    fine = cells.join(coarse, ["scene_id", "__gx", "__gy"]).select("scene_id", "__kx", "__ky", narrowed(CELLS[-1], "__kx", "__ky"))
    fine = bounded_broadcast(staged(fine, "near-cells"))
    placed = points.withColumn("__kx", key("x", CELLS[-1])).withColumn("__ky", key("y", CELLS[-1]))
    return placed.join(fine, ["scene_id", "__kx", "__ky"]).drop("__kx", "__ky")


def nearest_vertex(points: DataFrame, line: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Adds ``vtx`` and ``point_s`` of the nearest centerline vertex (ties to the lower), and the line's columns ``more``; points of scenes without a centerline go."""
    more = more or []
    vertex = F.struct("vtx", "s", F.col("cx").alias("px"), F.col("cy").alias("py"), *more)
    lines = line.groupBy("scene_id").agg(F.array_sort(F.collect_list(vertex)).alias("line"))
    distance = lambda v: (F.col("x") - v["px"]) * (F.col("x") - v["px"]) + (F.col("y") - v["py"]) * (F.col("y") - v["py"])
    best = F.array_min(F.transform("line", lambda v: F.struct(distance(v).alias("d2"), v["vtx"].alias("vtx"), v["s"].alias("s"), *(v[c].alias(c) for c in more))))
    found = _near_cells(points, lines).withColumn("__best", best)
    return found.select(*points.columns, F.col("__best.vtx").alias("vtx"), F.col("__best.s").alias("point_s"), *(F.col(f"__best.{c}").alias(c) for c in more))


def project(points: DataFrame, line: DataFrame) -> DataFrame:
    """Adds ``s`` and ``lateral`` on the segment whose middle is nearest (ties to the lower segment); the place on it is clipped to its ends."""
    order = Window.partitionBy("scene_id").orderBy("vtx")
    ends = line.withColumn("bx", F.lead("cx").over(order)).withColumn("by", F.lead("cy").over(order)).filter("bx is not null")
    segment = F.struct(
        F.col("vtx").alias("seg"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("bx") - F.col("cx")).alias("vx"), (F.col("by") - F.col("cy")).alias("vy"),
        F.col("s").alias("s0"), ((F.col("cx") + F.col("bx")) * 0.5).alias("px"), ((F.col("cy") + F.col("by")) * 0.5).alias("py"),
    )
    lines = ends.groupBy("scene_id").agg(F.array_sort(F.collect_list(segment)).alias("line"))

    def middle(v: Column) -> Column:
        d2 = (F.col("x") - v["px"]) * (F.col("x") - v["px"]) + (F.col("y") - v["py"]) * (F.col("y") - v["py"])
        return F.struct(d2.alias("d2"), *(v[c].alias(c) for c in ("seg", "ax", "ay", "vx", "vy", "s0")))

    near = _near_cells(points, lines).withColumn("__b", F.array_min(F.transform("line", middle))).drop("line")
    vx, vy, ax, ay = (F.col(f"__b.{c}") for c in ("vx", "vy", "ax", "ay"))
    raw = vx * vx + vy * vy
    square = F.when(raw < 1e-12, 1.0).otherwise(raw)
    near = near.withColumn("__l2", square).withColumn("__t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * vx + (F.col("y") - ay) * vy) / F.col("__l2"))))
    length, t = F.sqrt("__l2"), F.col("__t")
    px, py = F.col("x") - (ax + t * vx), F.col("y") - (ay + t * vy)
    return near.withColumn("s", F.col("__b.s0") + t * length).withColumn("lateral", px * (vy / length) - py * (vx / length)).withColumn("seg", F.col("__b.seg")).drop("__b", "__l2", "__t")
