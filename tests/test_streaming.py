import os

import pytest

from ballast.plans.ground import segment_ground
from ballast.sources import scene
from ballast.streaming.ingest import label_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stream_equals_batch(spark, tmp_path):
    points, tracks = scene.points(spark, SF), scene.tracks(spark, SF)
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = label_stream(stream, tracks, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).select("scene_id", "point_id", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, segment_ground(points, tracks).collect()))
