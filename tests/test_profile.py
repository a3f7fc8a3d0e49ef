"""Hand-made profiles against intervals worked out by hand."""

import math

import numpy as np
import pytest

from ballast.config import GroundConfig
from ballast.functions.units import steady_mean
from ballast.operators import profile, split

BIN = 0.25


def sides(spark, z, section=0):
    rows = [(0, section, 1, i, (i + 0.5) * BIN, float(v), 1) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "scene_id long, section_id int, side int, bin long, x double, z double, n long")
    return profile.ordered(df.withColumn("out_x", df["x"]))


def config(**more):
    return GroundConfig(graph_smooth_window=1, **more)


def result(spark, z, c):
    found = split.split_ground(profile.gradient(profile.moving_mean(sides(spark, z), c.graph_smooth_window)), c)
    rows = found.orderBy("i").collect()
    kinds = "".join(r["kind"][0] for r in rows)
    return rows[0]["emb_end"], kinds


FLAT = [-0.125 * i for i in range(13)] + [-1.5] * 8
RISE = [-0.125 * i for i in range(13)] + [-1.5 + 0.125 * k for k in range(1, 5)] + [-1.0] * 4
FALL = [-0.125 * i for i in range(21)]


def distant():
    x = (np.arange(45)) * BIN
    return np.interp(x, [0, 3, 6.5, 7.5, 8, 9, 11], [0, -1.5, -1.5, -2, -2, -1.5, -1.5]).tolist()


@pytest.mark.parametrize(
    ("z", "near", "far", "emb_end", "kinds"),
    [
        (FLAT, 0, 25, 13, "e" * 13 + "r" * 8),
        (RISE, 0, 25, 12, "e" * 10 + "d" * 7 + "r" * 4),
        (FALL, 0, 25, None, "e" * 21),
        (distant(), 6, 16, 13, "e" * 26 + "d" * 11 + "r" * 8),
        (FLAT, 6, 16, 13, "e" * 13 + "r" * 8),
    ],
    ids=["flat toe", "rise at once", "no stop", "distant ditch", "nothing to search"],
)
def test_split(spark, z, near, far, emb_end, kinds):
    assert result(spark, z, config(graph_ditch_search_min_m=float(near), graph_ditch_search_max_m=float(far))) == (emb_end, kinds)


def test_steady_mean(spark):
    values = np.random.default_rng(1).permutation([0.1, 0.2, 0.3, 2.612, -7.005, 1 / 3, 5900000.123, 6_800_000.001, 1e-9] * 40)
    for some in (values, np.sort(values), np.sort(values)[::-1], values[values < 100]):
        df = spark.createDataFrame([(float(v),) for v in some], "v double").repartition(3)
        assert df.agg(steady_mean("v")).first()[0] == math.fsum(some) / len(some)
    assert spark.createDataFrame([(None,), (1.5,), (2.5,)], "v double").agg(steady_mean("v")).first()[0] == 2
    assert spark.createDataFrame([(None,)], "v double").agg(steady_mean("v")).first()[0] is None
    assert math.isnan(spark.createDataFrame([(math.inf,), (1.0,)], "v double").agg(steady_mean("v")).first()[0])


def test_single_bin_has_no_kind(spark):
    assert split.split_ground(profile.gradient(profile.moving_mean(sides(spark, [1.0]), 1)), config()).count() == 0


def test_moving_mean(spark):
    got = [r["zs"] for r in profile.moving_mean(sides(spark, [0, 1, 4, 9, 16]), 3).orderBy("i").collect()]
    assert np.allclose(got, [1 / 3, 5 / 3, 14 / 3, 29 / 3, 41 / 3])


def test_moving_mean_even_window_is_widened(spark):
    got = [r["zs"] for r in profile.moving_mean(sides(spark, [0, 1, 4, 9, 16]), 4).orderBy("i").collect()]
    padded = [0, 0, 0, 1, 4, 9, 16, 16, 16]
    assert np.allclose(got, [sum(padded[i : i + 5]) / 5 for i in range(5)])


def test_gradient_has_weighted_gaps(spark):
    rows = [(0, 0, 1, 0, 0.0, 0.0), (0, 0, 1, 1, 1.0, 1.0), (0, 0, 1, 2, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "scene_id long, section_id int, side int, i long, out_x double, zs double")
    assert np.allclose([r["dz"] for r in profile.gradient(df).orderBy("i").collect()], np.gradient([0, 1, 9], [0, 1, 3]))


def test_gaps_are_filled(spark):
    rows = [(0, 0, 1, 4, 1.0, 2.0, 3), (0, 0, 1, 7, 1.75, 5.0, 1)]
    df = spark.createDataFrame(rows, "scene_id long, section_id int, side int, bin long, x double, z double, n long")
    got = profile.fill_gaps(df).orderBy("bin").collect()
    assert [(r["bin"], round(r["z"], 9), r["n"]) for r in got] == [(4, 2.0, 3), (5, 3.0, 0), (6, 4.0, 0), (7, 5.0, 1)]
