"""Radius semi-joins on grid buckets."""

from __future__ import annotations

from math import hypot

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a fine cell as a share of the radius.
FINE = 8


def _reach() -> list[tuple[int, int, bool]]:
    """Steps to the fine cells that can hold a point within the radius of a cell, and whether all their points are."""
    out = []
    for i in range(-FINE - 1, FINE + 2):
        for j in range(-FINE - 1, FINE + 2):
            if hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) <= FINE * (1 + 1e-9):
                out.append((i, j, hypot(abs(i) + 1, abs(j) + 1) <= FINE * (1 - 1e-9)))
    return out


def _compared(points: DataFrame, targets: DataFrame, radius: float, keys: list[str], strict: bool) -> DataFrame:
    """Targets go to the nine cells around them, points to one, so the join is an equi-join on keys and cell."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        targets.select(*keys, "rx", "ry", cell("rx").alias("cx0"), cell("ry").alias("cy0"))
        .withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        .select(*(F.col(k).alias(f"t_{k}") for k in keys), "rx", "ry", (F.col("cx0") + F.col("dx")).alias("t_cx"), (F.col("cy0") + F.col("dy")).alias("t_cy"))
    )
    celled = points.withColumn("__cx", cell("x")).withColumn("__cy", cell("y"))
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    close = d2 < radius * radius if strict else d2 <= radius * radius
    on = (F.col("__cx") == F.col("t_cx")) & (F.col("__cy") == F.col("t_cy")) & close
    for k in keys:
        on = on & (F.col(k) == F.col(f"t_{k}"))
    return celled.join(spread, on, "left_semi").drop("__cx", "__cy")


def within(points: DataFrame, targets: DataFrame, radius: float, keys: list[str], strict: bool = False) -> DataFrame:
    """The rows of ``points(x, y)`` that have a row of ``targets(rx, ry)`` with equal keys within the radius.

    Fine cells decide first: points of a cell that lies wholly within the radius
    of a target's cell are in, those that no target's cell can reach are out.
    Only points between the two are compared with targets, so the work grows with
    the points and not with points times targets.
    """
    side = radius / FINE
    fine = lambda c: F.floor(F.col(c) / side)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(sure).alias("sure")) for i, j, sure in _reach()))
    reached = (
        targets.select(*keys, fine("rx").alias("__fx"), fine("ry").alias("__fy")).distinct()
        .select(*keys, "__fx", "__fy", F.explode(steps).alias("step"))
        .groupBy(*keys, (F.col("__fx") + F.col("step.i")).alias("__fx"), (F.col("__fy") + F.col("step.j")).alias("__fy"))
        .agg(F.bool_or("step.sure").alias("__sure"))
    )
    celled = points.withColumn("__fx", fine("x")).withColumn("__fy", fine("y")).join(reached, [*keys, "__fx", "__fy"])
    sure = celled.filter("__sure").select(*points.columns)
    between = celled.filter("not __sure").select(*points.columns)
    return sure.unionByName(_compared(between, targets, radius, keys, strict))
