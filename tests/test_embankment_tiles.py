import numpy as np

from ballast.config import EmbankmentConfig
from ballast.plans import embankment


def test_sparse_tiles_find_what_the_whole_scene_finds(spark, monkeypatch):
    # two short banks along x, far from each other, of under 1,024 points each
    at = [(x + k / 2, y / 2) for x in (0, 215) for k in range(30) for y in range(-16, 17)]
    rows = [(0, n, float(x), y, -0.3 * max(0.0, abs(y) - 1), y == 0) for n, (x, y) in enumerate(at)]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, is_rail boolean")
    found = lambda: {r["point_id"] for r in embankment.grown(points, EmbankmentConfig()).filter("found").collect()}
    whole = found()
    monkeypatch.setattr(embankment, "TILE_POINTS", 0)
    tiled = found()
    assert len(whole) > 2 * 30  # more than the rails
    # at a bank's ends a tile's raster ends, the whole scene's doesn't
    inner = {n for n, (x, _) in enumerate(at) if 3 <= x % 215 <= 11}
    assert tiled & inner == whole & inner
    assert tiled <= whole


def test_vote_against_brute_force(spark):
    rng = np.random.default_rng(7)
    c = EmbankmentConfig()
    known, asked = rng.uniform(0, 4, (150, 3)), rng.uniform(0, 4, (60, 3))
    asked[0] = [30.0, 30.0, 30.0]  # so far that all weights are 0
    found = rng.random(150) < 0.3
    stored = spark.createDataFrame([(0, k, *map(float, p), bool(f)) for k, (p, f) in enumerate(zip(known, found))], "scene_id long, point_id long, x double, y double, z double, found boolean")
    queries = spark.createDataFrame([(0, 1000 + k, *map(float, p)) for k, p in enumerate(asked)], "scene_id long, point_id long, x double, y double, z double")
    got = {r["point_id"] - 1000: r["found"] for r in embankment.knn_vote(queries, stored, c).collect()}
    for k, p in enumerate(asked):
        d = np.sqrt(((known - p) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[: c.knn_k]
        weights = np.exp(-0.5 * (d[near] / c.knn_sigma) ** 2)
        assert got[k] == (c.class_weight * weights[found[near]].sum() > weights[~found[near]].sum())
