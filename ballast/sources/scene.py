"""The derived rail corridor on which the operators are tested, from the ``orders`` table.

Coordinates are integer millimetres; the SQL runs in Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """
SELECT scene_id, point_id,
  CAST(500000000 + t_mm AS BIGINT) AS x_mm,
  CAST(5900000000 + 1000000 * scene_id + l_mm + CAST(FLOOR(2e-6 * t_mm * t_mm + 5e-1) AS BIGINT) AS BIGINT) AS y_mm,
  CAST(CAST(FLOOR(z0 + 5e-1) AS BIGINT) + cents % 11 - 5 AS BIGINT) AS z_mm,
  CAST(CASE WHEN p % 20 = 7 THEN 5 WHEN ABS(d_mm - 2000) BETWEEN 600 AND 850 THEN 0 ELSE 1 END AS INT) AS label
FROM (
  SELECT *, ABS(l_mm) AS d_mm,
    CASE WHEN ABS(l_mm) <= 3200 THEN 3000e0
         WHEN ABS(l_mm) <= 8400 THEN 3000e0 - 5e-1 * (ABS(l_mm) - 3200)
         WHEN l_mm < -10000 THEN 1200e0
         WHEN l_mm < 0 THEN 400e0 + 5e-1 * (ABS(l_mm) - 8400)
         WHEN l_mm <= 10400 THEN 400e0
         WHEN l_mm <= 11200 THEN 400e0 - 5e-1 * (l_mm - 10400)
         WHEN l_mm <= 11800 THEN 0e0
         WHEN l_mm <= 13400 THEN 5e-1 * (l_mm - 11800)
         ELSE 800e0 END AS z0
  FROM (
    SELECT *, (p * 75487) % 60000 AS t_mm, (p * 56983) % 40001 - 20000 AS l_mm
    FROM (
      SELECT o_orderkey AS point_id, CAST(FLOOR(o_orderkey / 15000e0) AS BIGINT) AS scene_id, o_orderkey % 15000 AS p,
             CAST(FLOOR(o_totalprice * 100e0 + 5e-1) AS BIGINT) AS cents
      FROM {orders}) base) uv) prof"""

TRACKS_SQL = """
SELECT scene_id, track_id, seq,
  CAST(500000000 + 3000 * seq AS BIGINT) AS x_mm,
  CAST(5900000000 + 1000000 * scene_id + 4000 * track_id - 2000 + CAST(FLOOR(2e-6 * (3000 * seq) * (3000 * seq) + 5e-1) AS BIGINT) AS BIGINT) AS y_mm
FROM (SELECT DISTINCT CAST(FLOOR(o_orderkey / 15000e0) AS BIGINT) AS scene_id FROM {orders}) sc
CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS seq FROM {nation} WHERE n_nationkey <= 20) k
CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS track_id FROM {region} WHERE r_regionkey <= 1) tr"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, point_id, x, y, z in metres, label."""
    raw = spark.sql(POINTS_SQL, orders=_table(spark, sf_dir, "orders"))
    metres = [(F.col(f"{c}_mm") / F.lit(1000.0)).alias(c) for c in "xyz"]
    return raw.select("scene_id", "point_id", *metres, F.col("label").cast("smallint").alias("label"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, track_id, wkt: the corridor's tracks as line strings."""
    raw = spark.sql(TRACKS_SQL, **{t: _table(spark, sf_dir, t) for t in ("orders", "nation", "region")})
    metres = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.pmod(c, F.lit(1000)))
    vertices = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", metres("x_mm"), metres("y_mm")).alias("xy"))))
    return raw.groupBy("scene_id", "track_id").agg(
        F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(vertices, lambda v: v["xy"]), ", "), F.lit(")")).alias("wkt")
    )
