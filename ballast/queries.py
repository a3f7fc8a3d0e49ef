"""The corridor queries: one for each operator, over the derived scene, in whole millimetres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.config import EmbankmentConfig
from ballast.functions.units import mm
from ballast.operators import centerline, profile, smooth, split, tracks, voxel
from ballast.plans.ditch import DitchPlan
from ballast.plans.embankment import segment_embankment
from ballast.plans.ground import GroundPlan
from ballast.sources import scene


def _ground(spark: SparkSession, sf_dir: str) -> GroundPlan:
    return GroundPlan(scene.points(spark, sf_dir), scene.tracks(spark, sf_dir))


def _select(stage: Callable[[GroundPlan], DataFrame], *columns) -> Callable[[SparkSession, str], DataFrame]:
    """A query: a stage of the ground plan, with ids as they are and lengths (given as ``name`` or ``name=column``) in millimetres."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = stage(_ground(spark, sf_dir))
        return df.select(*(c if isinstance(c, Column) else c() if callable(c) else mm(c[1:]).alias(c[1:]) if c.startswith("~") else F.col(c) for c in columns))

    return query


_P = ("scene_id", "point_id")
_S = ("scene_id", "section_id")




def _z() -> Column:
    """Mean heights in nanometres: in millimetres they often lie halfway."""
    return F.floor(F.col("z") * 1e9 + 0.5).cast("long").alias("z_nm")


def _label(name: str = "label") -> Column:
    return F.col(name).cast("int").alias("label")


def _zx(g: GroundPlan) -> DataFrame:
    return profile.zx_profile(g.corridor, g.c.graph_x_bin)


def _per_side(df: DataFrame) -> DataFrame:
    return df.filter("i = 0 and len >= 2")


def _ditches(spark: SparkSession, sf_dir: str) -> DitchPlan:
    """On the ground segmenter's labels, ditches taken back to ground."""
    g = _ground(spark, sf_dir)
    known = g.points.drop("label").join(g.labels, ["scene_id", "point_id"])
    return DitchPlan(known.withColumn("label", F.when(F.col("label") == 11, 1).otherwise(F.col("label")).cast("int")))


def ditch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ditches(spark, sf_dir).labels


def ditch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.intervals(_ditches(spark, sf_dir).split).select("scene_id", "section_id", "side", "kind", mm("x_min").alias("x_min"), mm("x_max").alias("x_max"))


def embankment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_embankment(scene.points(spark, sf_dir), scene.tracks(spark, sf_dir), EmbankmentConfig())


def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = EmbankmentConfig()
    return voxel.tiles(scene.points(spark, sf_dir), c.tile_size, c.tile_overlap, c.tile_min_points)


def viewer_buffers(spark: SparkSession, sf_dir: str, size: int = 500_000) -> DataFrame:
    """What a viewer would be sent: points from the scene's least x, y and z on, in buffers by point_id."""
    points = scene.points(spark, sf_dir)
    low = points.groupBy("scene_id").agg(*(F.min(a).alias(f"{a}0") for a in "xyz"))
    moved = [mm(F.col(a) - F.col(f"{a}0")).alias(a) for a in "xyz"]
    return points.join(low, "scene_id").select("scene_id", "point_id", F.floor(F.col("point_id") / size).alias("buffer_id"), *moved, _label())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "class_filter": _select(lambda g: g.classes, *_P, _label),
        "scene_bbox": _select(lambda g: tracks.bounding_boxes(g.classes), "scene_id", "~x_min", "~x_max", "~y_min", "~y_max"),
        "track_vertices": _select(lambda g: tracks.decode_wkt(g.track_table), "scene_id", "track_id", "part", "seq", "~x", "~y"),
        "track_bbox_semi": _select(lambda g: tracks.select_tracks(tracks.decode_wkt(g.track_table), g.classes).select("scene_id", "track_id").distinct(), "scene_id", "track_id"),
        "densify_tracks": _select(lambda g: tracks.densify(tracks.select_tracks(tracks.decode_wkt(g.track_table), g.classes), g.c.densify_step), "scene_id", "track_id", "part", "k", "~rx", "~ry"),
        "rail_mask": _select(lambda g: g.rail_ids, *_P),
        "normalise": _select(lambda g: g.normalised, *_P, "~x", "~y", "~z", "is_rail"),
        "centerline_nodes": _select(lambda g: centerline.nodes(g.normalised.filter("is_rail"), g.c.curve_resolution), "scene_id", "kx", "ky", "~nx", "~ny"),
        "pca_axis": _select(
            lambda g: centerline.principal_axis(centerline.nodes(g.normalised.filter("is_rail"), g.c.curve_resolution)),
            "scene_id", "~mx", "~my", lambda: mm(F.col("fx") * 1000).alias("fx"), lambda: mm(F.col("fy") * 1000).alias("fy"),
        ),
        "trace_medians": _select(lambda g: (lambda n: centerline.trace(n, centerline.principal_axis(n), g.c.curve_resolution))(centerline.nodes(g.normalised.filter("is_rail"), g.c.curve_resolution)), "scene_id", "bin", "n", "~u", "~v"),
        "centerline_vertices": _select(lambda g: g.line, "scene_id", "vtx", "~cx", "~cy"),
        "arc_length": _select(lambda g: g.line, "scene_id", "vtx", "~s"),
        "section_cuts": _select(lambda g: g.cuts, *_S, "~s0", "~s1", "~p0x", "~p0y", lambda: mm(F.col("fx") * 1000).alias("fx"), lambda: mm(F.col("fy") * 1000).alias("fy")),
        "nearest_vertex": _select(lambda g: centerline.nearest_vertex(g.normalised, g.line), *_P, "vtx"),
        "section_assign": _select(lambda g: g.assigned, *_P, "section_id"),
        "rotate_section": _select(lambda g: g.rotated, *_P, "section_id", "~rx", "~ry"),
        "corridor_semi": _select(lambda g: g.corridor, *_P, "section_id"),
        "rail_center": _select(lambda g: g.corridor, *_P, "~rx"),
        "xz_profile": _select(lambda g: g.profile, *_S, "bin", "~x", _z, "n", "rail"),
        "zx_profile": _select(_zx, *_S, "bin", "~x", "n"),
        "rail_side_split": _select(lambda g: profile.split_by_rail(g.profile), *_S, "side", "bin", _z),
        "gap_fill": _select(lambda g: g.sides, *_S, "side", lambda: F.col("i").cast("long").alias("i"), "~x", _z, "n"),
        "moving_mean": _select(lambda g: g.slopes, *_S, "side", lambda: F.col("i").cast("long").alias("i"), "~zs"),
        "gradient": _select(lambda g: g.slopes, *_S, "side", lambda: F.col("i").cast("long").alias("i"), "~dz"),
        "emb_end": _select(lambda g: _per_side(split.embankment_end(split.runs(g.slopes, g.c.graph_uphill_slope), g.c)), *_S, "side", lambda: F.col("emb_end").cast("long").alias("emb_end")),
        "ditch_interval": _select(lambda g: _per_side(g.split), *_S, "side", "search_start", "search_stop", lambda: F.col("ditch_start").cast("long").alias("ditch_start"), lambda: F.col("ditch_end").cast("long").alias("ditch_end")),
        "profile_split": _select(lambda g: split.intervals(g.split), *_S, "side", "kind", "~x_min", "~x_max"),
        "ground_unsmoothed": _select(lambda g: g.unsmoothed, *_P, _label),
        "sl_projection": _select(lambda g: centerline.project(g.unsmoothed, g.line), *_P, "~s", lambda: mm("lateral").alias("across")),
        "sl_grid": _select(lambda g: smooth.label_grid(g.placed, g.c), "scene_id", "side", "si", "xi", "n_ground", "n_emb", "n_ditch", "n_total", "cell"),
        "boundary_curves": _select(lambda g: g.curves, "scene_id", "side", "si", "~emb_outer", "~ditch_inner", "~ditch_outer", "edge_locked"),
        "boundary_smooth": _select(lambda g: smooth.smooth_curves(g.curves, g.c), "scene_id", "side", "si", "~emb", lambda: mm("inner").alias("ditch_inner"), lambda: mm("outer").alias("ditch_outer"), "~emb_on", "~ditch_on"),
        "voxel_subsample": _select(lambda g: voxel.subsample(g.classes, 0.5), *_P),
        "raster_maxz": _select(lambda g: voxel.max_z(g.classes, 0.5), "scene_id", "iy", "ix", "~z"),
        "plot_parts": _select(lambda g: voxel.plot_parts(g.profile.filter("not rail"), ["scene_id", "section_id"]), *_S, "bin", "part"),
        "tile_assign": tile_assign,
        "viewer_buffers": viewer_buffers,
        "ditch_split": ditch_split,
        "ditch_labels": ditch_labels,
        "embankment_labels": embankment_labels,
        "ground_labels": _select(lambda g: g.labels, *_P, "label"),
        "label_counts": _select(lambda g: g.labels.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")), "scene_id", "label", "n"),
    }
