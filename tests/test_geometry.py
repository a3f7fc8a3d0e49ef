import time

import numpy as np
import pytest

from ballast.operators import centerline, proximity, raster, sections, smooth, tracks, voxel


@pytest.mark.parametrize(("length", "expected"), [(1.0, [0, 0.5, 1.0]), (1.2, [0, 0.5, 1.0, 1.2])])
def test_densify(spark, length, expected):
    vertices = spark.createDataFrame([(0, 0, 0, 0, 0.0, 5.0), (0, 0, 0, 1, 0.7, 5.0), (0, 0, 0, 2, length, 5.0)], "scene_id long, track_id long, part int, seq int, x double, y double")
    got = tracks.densify(vertices, 0.5).orderBy("k").collect()
    assert np.allclose([r["rx"] for r in got], expected)


def test_wkt(spark):
    rows = [(0, 1, "LINESTRING (0 0, 1.5 2)"), (0, 2, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))"), (0, 3, "POINT (1 1)"), (0, 4, None)]
    got = tracks.decode_wkt(spark.createDataFrame(rows, "scene_id long, track_id long, wkt string")).orderBy("track_id", "part", "seq").collect()
    assert [(r["track_id"], r["part"], r["seq"], r["x"]) for r in got] == [(1, 0, 0, 0.0), (1, 0, 1, 1.5), (2, 0, 0, 0.0), (2, 0, 1, 1.0), (2, 1, 0, 2.0), (2, 1, 1, 3.0), (2, 1, 2, 4.0)]


def test_track_selection_keeps_whole_tracks(spark):
    rows = [(0, 1, 0, 0, -10.0, 0.5), (0, 1, 0, 1, 10.0, 0.5), (0, 1, 0, 2, 99.0, 99.0), (0, 2, 0, 0, -10.0, 5.0), (0, 2, 0, 1, 10.0, 5.0)]
    vertices = spark.createDataFrame(rows, "scene_id long, track_id long, part int, seq int, x double, y double")
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 1.0)], "scene_id long, x double, y double")
    assert sorted((r["track_id"], r["seq"]) for r in tracks.select_tracks(vertices, points).collect()) == [(1, 0), (1, 1), (1, 2)]


@pytest.mark.parametrize(("strict", "ids"), [(False, [1, 2]), (True, [1])])
def test_radius_is_inclusive_or_strict(spark, strict, ids):
    points = spark.createDataFrame([(0, 1, 0.5, 0.0), (0, 2, 1.0, 0.0), (0, 3, 1.1, 0.0), (1, 4, 0.0, 0.0)], "scene_id long, point_id long, x double, y double")
    targets = spark.createDataFrame([(0, 0.0, 0.0)], "scene_id long, rx double, ry double")
    assert sorted(r["point_id"] for r in proximity.within(points, targets, 1.0, ["scene_id"], strict).collect()) == ids


def test_voxel_tie_takes_lowest_id(spark):
    points = spark.createDataFrame([(0, 9, 0.25, 0.5, 0.5), (0, 4, 0.75, 0.5, 0.5)], "scene_id long, point_id long, x double, y double, z double")
    assert [r["point_id"] for r in voxel.subsample(points, 1.0).collect()] == [4]


def test_cubic_fit():
    u = np.linspace(0, 60, 40)
    v = 1 + 0.1 * u - 0.002 * u**2 + 1e-5 * u**3
    got_u, got_v, kind = centerline.fit_curve(u, v, 1.5)
    assert kind == "cubic"
    assert np.allclose(got_v, 1 + 0.1 * got_u - 0.002 * got_u**2 + 1e-5 * got_u**3)


def test_bends_need_knots():
    u = np.linspace(0, 400, 300)
    v = 40 * np.sin(u / 25)
    _, got, kind = centerline.fit_curve(u, v, 1.0)
    assert kind.startswith("spline")
    assert len(got) == 399 or len(got) == 400


def test_cut_before_bend():
    xy = np.array([[0.0, 0], [10, 0], [10, 10], [20, 10]])
    s = np.array([0.0, 10, 20, 30])
    assert sections.cut_end(0.0, xy, s, 2.0, 30.0, 4.0, 1.1) == 8.0
    assert sections.cut_end(8.0, xy, s, 2.0, 30.0, 4.0, 1.1) == 10.0


def test_gaussian_kernel():
    weights = smooth.kernel(20 / 1.5)
    assert len(weights) == 107
    assert np.isclose(sum(weights), 1)


def test_closing_erodes_at_border():
    mask = np.ones((3, 3), bool)
    assert raster.eroded(mask, raster.disk(1)).sum() == 1


def test_holes_and_components():
    mask = np.zeros((7, 9), bool)
    mask[1:6, 1:6] = True
    mask[3, 3] = False
    mask[1, 8] = True
    assert raster.holes_filled(mask)[3, 3]
    assert raster.large_components(mask, 2).sum() == 24


def test_nearest_against_brute_force():
    mask = np.random.default_rng(1).random((17, 23)) < 0.05
    d2, iy, ix = raster.nearest(mask)
    ys, xs = np.nonzero(mask)
    yy, xx = np.mgrid[:17, :23]
    brute = ((yy[..., None] - ys) ** 2 + (xx[..., None] - xs) ** 2).min(axis=2)
    assert (d2 == brute).all()
    assert ((yy - iy) ** 2 + (xx - ix) ** 2 == brute).all()
    assert mask[iy, ix].all()


def test_nearest_with_ties_and_a_limit():
    rng = np.random.default_rng(2)
    for shape, share in (((7, 9), 0.2), ((30, 40), 0.02), ((1, 50), 0.1), ((50, 1), 0.1)):
        mask = rng.random(shape) < share
        mask[shape[0] // 2, shape[1] // 2] = True
        ys, xs = np.nonzero(mask)
        y, x = np.mgrid[: shape[0], : shape[1]]
        every = (y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2
        least = every.min(axis=-1)
        d2, iy, ix = raster.nearest(mask)
        assert (d2 == least).all() and mask[iy, ix].all() and ((iy - y) ** 2 + (ix - x) ** 2 == least).all()
        assert (ix == np.where(every == least[..., None], xs, 10**6).min(axis=-1)).all()
        bounded, ly, _ = raster.nearest(mask, 3)
        assert (bounded[least <= 9] == least[least <= 9]).all() and (bounded[least > 9] > 9).all() and (ly[least <= 9] == iy[least <= 9]).all()


@pytest.mark.parametrize("strict", [False, True])
def test_radius_join_against_brute_force(spark, strict):
    rng = np.random.default_rng(3)
    xy, targets = rng.integers(0, 4000, (800, 2)) / 100.0, rng.integers(0, 4000, (25, 2)) / 100.0
    xy[:50] = targets[rng.integers(0, 25, 50)] + [3.0, 0.0]  # just at the radius
    points = spark.createDataFrame([(k % 2, k, *map(float, p)) for k, p in enumerate(xy)], "scene_id long, point_id long, x double, y double")
    rails = spark.createDataFrame([(k % 2, *map(float, t)) for k, t in enumerate(targets)], "scene_id long, rx double, ry double")
    got = sorted(r["point_id"] for r in proximity.within(points, rails, 3.0, ["scene_id"], strict).collect())
    wanted = []
    for k, (x, y) in enumerate(xy):
        d2 = [(x - a) * (x - a) + (y - b) * (y - b) for j, (a, b) in enumerate(targets) if j % 2 == k % 2]
        if min(d2) < 9.0 or (not strict and min(d2) == 9.0):
            wanted.append(k)
    assert got == wanted


def test_nearest_parts_of_a_bent_line(spark):
    at = np.linspace(0, 3 * np.pi, 400)
    line = np.column_stack([60 * np.cos(at / 3) * (1 + at / 10), 60 * np.sin(at / 3) * (1 + at / 10)])
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    rng = np.random.default_rng(4)
    xy = rng.uniform(-150, 150, (600, 2))
    vertices = spark.createDataFrame([(0, k, float(x), float(y), float(d)) for k, ((x, y), d) in enumerate(zip(line, s))], "scene_id long, vtx int, cx double, cy double, s double")
    points = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(1, 0, 0.0, 0.0)], "scene_id long, point_id long, x double, y double")
    got = {r["point_id"]: r for r in centerline.nearest_vertex(points, vertices).collect()}
    middles = (line[1:] + line[:-1]) / 2
    projected = {r["point_id"]: r for r in centerline.project(points, vertices).collect()}
    assert len(got) == len(projected) == 600
    for k, p in enumerate(xy):
        assert got[k]["vtx"] == ((line - p) ** 2).sum(axis=1).argmin() and got[k]["point_s"] == s[got[k]["vtx"]]
        seg = ((middles - p) ** 2).sum(axis=1).argmin()
        v = line[seg + 1] - line[seg]
        t = min(1.0, max(0.0, (p - line[seg]) @ v / (v @ v)))
        assert projected[k]["seg"] == seg and projected[k]["s"] == pytest.approx(s[seg] + t * np.hypot(*v))


def test_sections_of_a_bent_line_against_a_plain_walk(spark):
    at = np.linspace(-np.pi / 2, np.pi / 2, 150)[1:]
    line = np.concatenate([np.column_stack([np.linspace(0, 15, 51), np.zeros(51)]), np.column_stack([15 + 6 * np.cos(at), 6 + 6 * np.sin(at)])])
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    vertices = spark.createDataFrame([(0, k, float(x), float(y), float(d)) for k, ((x, y), d) in enumerate(zip(line, s))], "scene_id long, vtx int, cx double, cy double, s double")
    cuts = sections.cuts(vertices, 2.0, 10.0, 4.0, 1.01)

    def place(d):
        return np.array([np.interp(d, s, line[:, 0]), np.interp(d, s, line[:, 1])])

    wanted, begin = [], 0.0
    while begin < s[-1]:
        end, a = min(begin + 10.0, s[-1]), begin
        stop = end
        while end - begin > 2.0 and a < end:  # in steps of 4 the first stretch that is longer than 1.01 of its chord
            b = min(a + 4.0, end)
            if (b - a) / np.hypot(*(place(b) - place(a))) > 1.01:
                stop = min(begin + 2.0, s[-1]) if a <= begin + 2.0 else a
                break
            a = b
        wanted.append((begin, stop))
        begin = stop
    got = [(r["s0"], r["s1"]) for r in cuts.orderBy("section_id").collect()]
    assert len(got) > 5 and got == [(pytest.approx(a), pytest.approx(b)) for a, b in wanted]
    points = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(line)], "scene_id long, point_id long, x double, y double")
    for r in sections.assign(points, vertices, cuts).collect():
        assert got[r["section_id"]][0] <= s[r["point_id"]] < got[r["section_id"]][1]
    assert sections.assign(points, vertices, cuts).count() == 199  # the last vertex is in none


def test_width_margin_trims_sections(spark):
    rows = [(0, 0, k, float(k), 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(11)]
    given = spark.createDataFrame(rows, "scene_id long, section_id int, point_id long, x double, y double, p0x double, p0y double, fx double, fy double")
    kept = lambda **more: sorted(r["point_id"] for r in sections.rotate(given, **more).collect())
    assert kept() == kept(margin=1.0) == list(range(11))
    assert kept(margin=-2.0) == kept(margin=-2.0, centre_x=True) == list(range(2, 9))


def test_nearest_vertex_of_a_dense_line_takes_time_in_proportion(spark):
    n = 3000
    u = np.linspace(0, 60, n)
    line = spark.createDataFrame([(0, i, float(u[i]), 0.0, float(u[i])) for i in range(n)], "scene_id long, vtx int, cx double, cy double, s double")
    rows = [(0, int(i), float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in np.arange(0.37, 60, 2) for y in (-3.0, -1.0, 1.0, 3.0))]
    began = time.monotonic()
    got = {r["point_id"]: r["vtx"] for r in centerline.nearest_vertex(spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double"), line).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: int(np.argmin((u - x) ** 2 + y**2)) for _, i, x, y in rows}
