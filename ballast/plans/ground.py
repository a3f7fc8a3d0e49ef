"""The ground segmenter: rail, embankment, ditch and ground from cross-section profiles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.config import GroundConfig
from ballast.functions.units import steady_mean
from ballast.operators import centerline, profile, proximity, sections, smooth, split, tracks
from ballast.storage import bounded_broadcast, staged


class GroundPlan:
    """The stages as DataFrames, each built on first use.  Stages that several others read are written and read again.

    ``points``: scene_id, point_id, x, y, z, label.  ``track_table``: scene_id, track_id, wkt.
    """

    def __init__(self, points: DataFrame, track_table: DataFrame, config: GroundConfig = GroundConfig()):
        self.points, self.track_table, self.c = points, track_table, config

    @cached_property
    def classes(self) -> DataFrame:
        """Points of the ground, rail and temporary classes."""
        return self.points.filter(F.col("label").isin(self.c.ground_label, self.c.rail_label, self.c.tmp_label))

    @cached_property
    def rail_points(self) -> DataFrame:
        """Dense points on the tracks that meet the scene's bounding box."""
        vertices = tracks.select_tracks(tracks.decode_wkt(self.track_table), self.classes)
        return tracks.densify(vertices, self.c.densify_step).select("scene_id", "rx", "ry")

    @cached_property
    def rail_ids(self) -> DataFrame:
        """Each id once, as points are joined with them: rows of a repeated id would be multiplied."""
        return proximity.within(self.classes, self.rail_points, self.c.rail_radius, ["scene_id"]).select("scene_id", "point_id").distinct()

    @cached_property
    def normalised(self) -> DataFrame:
        """Working labels (temporary: on the tracks; else ground) and coordinates less the mean x and y and the least z; scenes without rail points go."""
        marked = self.classes.join(self.rail_ids.withColumn("__r", F.lit(True)), ["scene_id", "point_id"], "left")
        marked = marked.withColumn("is_rail", F.coalesce("__r", F.lit(False))).drop("__r")
        origin = marked.groupBy("scene_id").agg(steady_mean("x").alias("x0"), steady_mean("y").alias("y0"), F.min("z").alias("z0"), F.bool_or("is_rail").alias("any")).filter("any").drop("any")
        origin = bounded_broadcast(staged(origin, "origin"))  # a row for each scene: its points needn't meet
        out = marked.join(origin, "scene_id").select(
            "scene_id", "point_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), (F.col("z") - F.col("z0")).alias("z"),
            F.when(F.col("is_rail"), self.c.tmp_label).otherwise(self.c.ground_label).alias("label"), "is_rail", F.col("label").alias("given"),
        )
        return staged(out, "normalised")

    @cached_property
    def line(self) -> DataFrame:
        return staged(centerline.centerline(self.normalised.filter("is_rail"), self.c.curve_resolution), "line")

    @cached_property
    def cuts(self) -> DataFrame:
        c = self.c
        return staged(sections.cuts(self.line, c.length_min, c.length_max, c.curve_resolution, c.max_curve_ratio), "cuts")

    @cached_property
    def assigned(self) -> DataFrame:
        """Rows that are equal in every column count as one point; rows that share only the id are points of their own."""
        return sections.assign(self.normalised.distinct(), self.line, self.cuts)

    @cached_property
    def rotated(self) -> DataFrame:
        return staged(sections.rotate(self.assigned, margin=self.c.width_margin), "rotated")

    @cached_property
    def corridor(self) -> DataFrame:
        near = sections.corridor(self.rotated, F.col("is_rail"), F.lit(True), self.c.distance_limit)
        return staged(sections.centre_on_rail(near, F.col("is_rail")), "corridor")

    @cached_property
    def profile(self) -> DataFrame:
        return profile.xz_profile(self.corridor, self.c.graph_x_bin, F.col("is_rail"))

    @cached_property
    def sides(self) -> DataFrame:
        return profile.ordered(profile.fill_gaps(profile.split_by_rail(self.profile)))

    @cached_property
    def slopes(self) -> DataFrame:
        return staged(profile.gradient(profile.moving_mean(self.sides, self.c.graph_smooth_window)), "slopes")

    @cached_property
    def split(self) -> DataFrame:
        return split.split_ground(self.slopes, self.c)

    @cached_property
    def unsmoothed(self) -> DataFrame:
        """All points of scenes with rail, with their label before smoothing."""
        c = self.c
        found = split.section_labels(self.corridor, split.intervals(self.split), c.graph_x_bin, c.embankment_label, c.ditch_label, c.ground_label)
        new = found.select("scene_id", "point_id", "new_label")
        joined = self.normalised.join(new, ["scene_id", "point_id"], "left")
        return staged(joined.withColumn("label", F.when(F.col("is_rail"), c.embankment_label).otherwise(F.coalesce("new_label", "label"))).drop("new_label"), "unsmoothed")

    @cached_property
    def placed(self) -> DataFrame:
        return staged(smooth.placed(centerline.project(self.unsmoothed, self.line), self.c), "placed")

    @cached_property
    def curves(self) -> DataFrame:
        return smooth.boundaries(smooth.label_grid(self.placed, self.c), self.c)

    @cached_property
    def smoothed(self) -> DataFrame:
        c = self.c
        if not c.smooth:
            return self.unsmoothed
        new = smooth.smooth_labels(self.placed, smooth.smooth_curves(self.curves, c), c)
        joined = self.unsmoothed.join(new, ["scene_id", "point_id"], "left")
        return joined.withColumn("label", F.when(F.col("is_rail"), c.embankment_label).otherwise(F.coalesce("new_label", "label"))).drop("new_label")

    @cached_property
    def labels(self) -> DataFrame:
        """scene_id, point_id, label of every point: given rail points on the embankment are rail again, elsewhere ground; other classes and scenes without a centerline stay."""
        c = self.c
        final = F.when(F.col("given") != c.rail_label, F.col("label")).when(F.col("label") == c.embankment_label, c.rail_label).otherwise(c.ground_label)
        usable = bounded_broadcast(self.line.select("scene_id").distinct())
        new = self.smoothed.join(usable, "scene_id", "left_semi").select("scene_id", "point_id", final.alias("new_label"))
        joined = self.points.join(new, ["scene_id", "point_id"], "left")
        return joined.select("scene_id", "point_id", F.coalesce("new_label", "label").cast("smallint").alias("label"))


def segment_ground(points: DataFrame, track_table: DataFrame, config: GroundConfig = GroundConfig()) -> DataFrame:
    """scene_id, point_id, label of every row of ``points(scene_id, point_id, x, y, z, label)`` by the tracks ``(scene_id, track_id, wkt)``."""
    return GroundPlan(points, track_table, config).labels
