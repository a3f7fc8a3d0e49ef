"""Whole segmenters over the derived scene."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ballast import oracles, queries
from ballast.plans.ditch import segment_ditches
from ballast.plans.embankment import segment_embankment
from ballast.sources import scene

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
NAMES = ["rail_mask", "centerline_vertices", "section_assign", "ditch_interval", "ground_labels", "tile_assign", "raster_maxz"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("orders", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    found = db.execute(oracles.all_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Tables in which ids repeat: 300 orders come again with another price, 300 others as they are."""
    path = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    orders = f"SELECT * FROM '{SF}/orders.parquet'"
    other = f"SELECT * REPLACE (o_totalprice + 3e-2 AS o_totalprice) FROM ({orders}) WHERE o_orderkey < 300"
    con.execute(f"COPY ({orders} UNION ALL {other} UNION ALL {orders} WHERE o_orderkey BETWEEN 600 AND 899) TO '{path}/orders.parquet'")
    for t in ("nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet'")
    for t in ("orders", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["rail_mask", "centerline_vertices", "section_assign", "rotate_section"])
def test_query_equals_sql_with_repeated_ids(spark, repeated, name):
    sf, con = repeated
    got = queries.queries()[name](spark, sf)
    found = con.execute(oracles.all_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize(("name", "value"), [("moving_mean", "zs"), ("gradient", "dz")])
def test_profile_is_that_of_sql_with_repeated_ids(spark, repeated, name, value):
    """But for the last millimetre, as means that lie halfway depend on the order of summation."""
    sf, con = repeated
    got = {tuple(r[:4]): r[4] for r in queries.queries()[name](spark, sf).select("scene_id", "section_id", "side", "i", value).collect()}
    expected = {tuple(r[:4]): r[4] for r in con.execute(f"SELECT scene_id, section_id, side, i, {value} FROM ({oracles.all_sql()[name]})").fetchall()}
    assert got.keys() == expected.keys()
    assert max(abs(got[k] - v) for k, v in expected.items()) <= 1


def test_profile_is_the_same_in_any_order_of_rows(spark, tmp_path):
    """To the last bit, as values halfway between two millimetres would else change from run to run."""
    found = []
    for order in ("o_orderkey", "o_orderkey DESC", "hash(o_orderkey)"):
        path = tmp_path / f"sf{len(found)}"
        path.mkdir()
        for t in ("orders", "nation", "region"):
            duckdb.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' {f'ORDER BY {order}' if t == 'orders' else ''}) TO '{path}/{t}.parquet'")
        slopes = queries._ground(spark, str(path)).slopes
        found.append(sorted(map(tuple, slopes.select("section_id", "side", "i", "out_x", "z", "zs", "dz").collect())))
    assert len(found[0]) > 600
    assert found[0] == found[1] == found[2]


def test_labels_keep_other_classes(spark):
    points = scene.points(spark, SF)
    before = {r["point_id"]: r["label"] for r in points.collect()}
    after = {r["point_id"]: r["label"] for r in queries.queries()["ground_labels"](spark, SF).collect()}
    assert before.keys() == after.keys()
    assert all(after[k] == v for k, v in before.items() if v == 5)
    assert set(after.values()) <= {0, 1, 5, 10, 11}


def test_embankment_only_from_ground(spark):
    points = scene.points(spark, SF)
    before = {r["point_id"]: r["label"] for r in points.collect()}
    after = {r["point_id"]: r["label"] for r in segment_embankment(points, scene.tracks(spark, SF)).collect()}
    assert before.keys() == after.keys()
    assert {(before[k], v) for k, v in after.items() if v != before[k]} <= {(1, 10)}


def test_no_tracks_leaves_labels(spark):
    points = scene.points(spark, SF)
    none = scene.tracks(spark, SF).limit(0)
    after = {r["point_id"]: r["label"] for r in segment_embankment(points, none).collect()}
    assert after == {r["point_id"]: r["label"] for r in points.collect()}


def test_ditches_compute_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("smallint")
    def counted(label):
        read.add(1)
        return 10 if label == 0 else label

    points = scene.points(spark, SF)
    after = segment_ditches(points.withColumn("label", counted("label"))).collect()
    assert len(after) == read.value == points.count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["scene_id", "point_id", "label"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
