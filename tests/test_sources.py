import struct

import numpy as np
import pytest

from ballast.config import GroundConfig, from_json, read_params
from ballast.sources import jdbc, las


def las_file(path, points, kind=1, record=28):
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = b"\x01\x02"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, kind, record, len(points))
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 1000.0, 2000.0, 0.0)
    body = b"".join(struct.pack("<iiiHBB", x, y, z, 0, 0, label).ljust(record, b"\0") for x, y, z, label in points)
    path.write_bytes(bytes(head) + body)


def test_las(spark, tmp_path):
    las_file(tmp_path / "a.las", [(1, 2, 3, 5), (1500, 0, -7, 11)])
    las_file(tmp_path / "b.las", [])
    spark.dataSource.register(las.LasDataSource)
    got = spark.read.format("las").load(str(tmp_path)).orderBy("point_id").collect()
    assert [(r["scene_id"], r["point_id"], r["label"]) for r in got] == [(0, 0, 5), (0, 1, 11)]
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], [[1000.001, 2000.002, 0.003], [1001.5, 2000, -0.007]])


def test_params(tmp_path):
    (tmp_path / "db").write_text("# a comment\n\nhost = h\npassword=a=b\n")
    assert read_params(str(tmp_path / "db")) == {"host": "h", "password": "a=b"}


def test_config(tmp_path):
    (tmp_path / "c").write_text('{"distance_limit": 9, "unknown": 1}')
    assert from_json(GroundConfig, str(tmp_path / "c")).distance_limit == 9
    with pytest.raises(ValueError, match="lengths"):
        GroundConfig(length_min=0)


def test_track_query_takes_plain_names_only():
    assert "ST_MakeEnvelope(0.0, 2.0, 1.0, 3.0" in jdbc.track_query("rail.tracks", "geom", "id", (0, 1, 2, 3))
    with pytest.raises(ValueError, match="plain"):
        jdbc.track_query("t; drop table x", "geom", "id", (0, 1, 2, 3))
