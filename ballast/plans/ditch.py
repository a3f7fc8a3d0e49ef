"""The ditch segmenter: which ground points next to a known embankment are ditch."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.config import DitchConfig
from ballast.operators import centerline, profile, sections, split
from ballast.operators.profile import SECTION
from ballast.storage import bounded_broadcast, staged


def two_parts(bins: DataFrame, most_gap: int) -> DataFrame:
    """Profiles cut where more than ``most_gap`` bins lack, and their two longest parts as sides.

    Of equally long parts the first is taken; the one further left is side -1.
    A part alone is side -1 if its mean x is below 0, else 1.
    """
    order = Window.partitionBy(*SECTION).orderBy("bin")
    parts = bins.withColumn("part", F.sum(F.when(F.col("bin") - F.lag("bin").over(order) > most_gap, 1).otherwise(0)).over(order))
    sizes = parts.groupBy(*SECTION, "part").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("first_x"), F.avg("x").alias("mean_x"))
    longest = Window.partitionBy(*SECTION).orderBy(F.desc("size"), "first_x")
    chosen = sizes.withColumn("nth", F.row_number().over(longest)).filter("nth <= 2")
    across = Window.partitionBy(*SECTION).orderBy("mean_x", "part")
    alone = F.count(F.lit(1)).over(Window.partitionBy(*SECTION)) == 1
    side = F.when(alone, F.when(F.col("mean_x") < 0, -1).otherwise(1)).otherwise(F.when(F.row_number().over(across) == 1, -1).otherwise(1))
    chosen = chosen.withColumn("side", side).select(*SECTION, "part", "side")
    return parts.join(chosen, [*SECTION, "part"]).drop("part").withColumn("out_x", F.col("side") * F.col("x"))


class DitchPlan:
    """The stages as DataFrames; ``points``: scene_id, point_id, x, y, z, label.  Scenes without embankment stay as they are."""

    def __init__(self, points: DataFrame, config: DitchConfig = DitchConfig()):
        self.given, self.c = points, config

    @cached_property
    def points(self) -> DataFrame:
        """Written once: they are often another segmenter's result and read three times."""
        return staged(self.given.select("scene_id", "point_id", "x", "y", "z", "label"), "ditch-given")

    @cached_property
    def normalised(self) -> DataFrame:
        c = self.c
        origin = self.points.groupBy("scene_id").agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"), F.min("z").alias("z0"))
        origin = bounded_broadcast(staged(origin, "ditch-origin"))
        classes = self.points.filter(F.col("label").isin(c.embankment_label, c.rail_label, c.ground_label)).join(origin, "scene_id")
        moved = [(F.col(a) - F.col(f"{a}0")).alias(a) for a in "xyz"]
        return staged(classes.select("scene_id", "point_id", *moved, F.col("label").cast("int").alias("label")), "ditch-points")

    @cached_property
    def line(self) -> DataFrame:
        return staged(centerline.centerline(self.normalised.filter(F.col("label") == self.c.embankment_label), self.c.curve_resolution), "ditch-line")

    @cached_property
    def cuts(self) -> DataFrame:
        c = self.c
        return staged(sections.cuts(self.line, c.length_min, c.length_max, c.curve_resolution, c.max_curve_ratio), "ditch-cuts")

    @cached_property
    def rotated(self) -> DataFrame:
        return staged(sections.rotate(sections.assign(self.normalised, self.line, self.cuts), centre_x=True, margin=self.c.width_margin), "ditch-rotated")

    @cached_property
    def candidates(self) -> DataFrame:
        """Ground points of a section nearer to its embankment than the limit."""
        c = self.c
        near = sections.corridor(self.rotated, F.col("label") == c.embankment_label, F.col("label") != c.rail_label, c.distance_limit)
        return staged(near.filter(F.col("label") != c.embankment_label), "ditch-candidates")

    @cached_property
    def bins(self) -> DataFrame:
        return profile.xz_profile(self.candidates, self.c.graph_x_bin, F.lit(False)).drop("rail")

    @cached_property
    def parts(self) -> DataFrame:
        return two_parts(self.bins, self.c.graph_max_gap_bins)

    @cached_property
    def split(self) -> DataFrame:
        slopes = profile.gradient(profile.moving_mean(profile.ordered(self.parts), self.c.graph_smooth_window))
        return split.split_ditch(staged(slopes, "ditch-slopes"), self.c).filter("len >= 2")

    @cached_property
    def labels(self) -> DataFrame:
        c = self.c
        found = split.intervals(self.split)
        new = split.section_labels(self.candidates, found, c.graph_x_bin, c.embankment_label, c.ditch_label, c.ground_label)
        joined = self.points.join(new.select("scene_id", "point_id", "new_label"), ["scene_id", "point_id"], "left")
        return joined.select("scene_id", "point_id", F.coalesce("new_label", "label").cast("smallint").alias("label"))


def segment_ditches(points: DataFrame, config: DitchConfig = DitchConfig()) -> DataFrame:
    """scene_id, point_id, label of every row of ``points(scene_id, point_id, x, y, z, label)``."""
    return DitchPlan(points, config).labels
