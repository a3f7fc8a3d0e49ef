"""Settings of the three segmenters.  Field names are those of the JSON configuration files."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class GroundConfig:
    distance_limit: float = 25.0
    ground_label: int = 1
    rail_label: int = 0
    rail_radius: float = 1.0
    embankment_label: int = 10
    ditch_label: int = 11
    length_min: float = 2.0
    length_max: float = 10.0
    width_margin: float = 0.0
    max_curve_ratio: float = 1.1
    curve_resolution: float = 1.5
    graph_x_bin: float = 0.25
    graph_uphill_slope: float = 0.1
    graph_embankment_min_stop_m: float = 0.6
    graph_min_embankment_m: float = 1.6
    graph_noise_points: int = 2
    graph_smooth_window: int = 5
    graph_ditch_min_downhill_m: float = 0.4
    graph_ditch_min_uphill_m: float = 0.4
    graph_ditch_immediate_points_m: float = 0.7
    graph_ditch_max_flat_m: float = 1.0
    graph_ditch_max_uphill_m: float = 2.0
    graph_ditch_search_min_m: float = 6.0
    graph_ditch_search_max_m: float = 16.0
    smooth: bool = True
    smooth_level: float = 20.0
    densify_step: float = 0.5
    tmp_label: int = 100

    def __post_init__(self):
        if self.length_min <= 0 or self.length_max < self.length_min:
            raise ValueError("lengths must satisfy 0 < length_min <= length_max")
        if self.graph_x_bin <= 0 or self.curve_resolution <= 0:
            raise ValueError("bins must be positive")
        if self.graph_ditch_search_max_m < self.graph_ditch_search_min_m:
            raise ValueError("the ditch search must end after it begins")

    def points(self, metres: float, least: int = 1) -> int:
        """A distance along a profile as a number of bins, rounded up."""
        return max(least, math.ceil(metres / self.graph_x_bin - 1e-9))


@dataclass(frozen=True)
class DitchConfig:
    distance_limit: float = 8.0
    ground_label: int = 1
    rail_label: int = 0
    embankment_label: int = 10
    ditch_label: int = 11
    length_min: float = 0.5
    length_max: float = 10.0
    width_margin: float = 0.0
    max_curve_ratio: float = 1.03
    curve_resolution: float = 0.25
    graph_x_bin: float = 0.25
    graph_uphill_slope: float = 0.2
    graph_min_uphill_points: int = 3
    graph_noise_points: int = 2
    graph_smooth_window: int = 3
    graph_max_gap_bins: int = 3


@dataclass(frozen=True)
class EmbankmentConfig:
    """Settings that a file may name but that have no effect there (radius, voxel, tiles) have the effective values as defaults."""

    grid_cell_size: float = 0.5
    max_dist_m: float = 6.0
    crown_width_m: float = 3.0
    min_slope: float = 0.12
    max_slope: float = 5.5
    min_global_slope: float = 0.05
    max_embankment_height: float = 6.0
    max_elev_diff: float = 0.2
    closing_radius: int = 1
    erosion_radius: int = 2
    min_cluster_size: int = 50
    ground_label: int = 1
    rail_label: int = 0
    embankment_label: int = 10
    rail_radius: float = 0.5
    voxel_size: float = 0.1
    tile_size: float = 40.0
    tile_overlap: float = 10.0
    tile_min_points: int = 1024
    knn_k: int = 25
    knn_sigma: float = 0.3
    class_weight: float = 3.0


def from_json(kind: type, path: str, **overrides):
    """A configuration from a flat JSON file; unknown keys are ignored."""
    with open(path) as f:
        given = json.load(f)
    known = {x.name for x in fields(kind)}
    return kind(**{k: v for k, v in given.items() if k in known} | overrides)


def read_params(path: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and those that begin with ``#`` are skipped; the first ``=`` splits."""
    out = {}
    with open(path) as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip()
    return out
