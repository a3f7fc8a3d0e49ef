"""Track geometry from a database with a spatial extension."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_name = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$")


def track_query(table: str, geometry: str, key: str, box: tuple[float, float, float, float]) -> str:
    """Text of the tracks that meet a box (x_min, x_max, y_min, y_max); the database filters, whole geometries come back."""
    for name in (table, geometry, key):
        if not _name.match(name):
            raise ValueError(f"not a plain name: {name!r}")
    x0, x1, y0, y1 = map(float, box)
    return f"SELECT {key} AS track_id, ST_AsText({geometry}) AS wkt FROM {table} WHERE ST_Intersects({geometry}, ST_MakeEnvelope({x0!r}, {y0!r}, {x1!r}, {y1!r}, ST_SRID({geometry})))"


def read_tracks(spark: SparkSession, params: dict[str, str], table: str, geometry: str, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """track_id, wkt through JDBC; ``params`` as ``ballast.config.read_params`` reads them (host, port, dbname, user, password)."""
    url = f"jdbc:postgresql://{params['host']}:{params.get('port', '5432')}/{params['dbname']}"
    return (
        spark.read.format("jdbc").option("url", url).option("query", track_query(table, geometry, key, box))
        .option("user", params.get("user", "")).option("password", params.get("password", "")).load()
    )
