"""Raster operators in numpy, for one tile of bounded size at a time."""

from __future__ import annotations

import numpy as np

from ballast.config import EmbankmentConfig


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The mask moved by (dy, dx); false comes in at the edges."""
    out = np.zeros_like(mask)
    ny, nx = mask.shape
    if abs(dy) < ny and abs(dx) < nx:
        out[max(dy, 0) : ny + min(dy, 0), max(dx, 0) : nx + min(dx, 0)] = mask[max(-dy, 0) : ny + min(-dy, 0), max(-dx, 0) : nx + min(-dx, 0)]
    return out


def disk(radius: int) -> list[tuple[int, int]]:
    reach = range(-radius, radius + 1)
    return [(dy, dx) for dy in reach for dx in reach if dy * dy + dx * dx <= radius * radius]


SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def dilated(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, dy, dx) for dy, dx in shape])


def eroded(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    """Cells all of whose neighbours are set; what lies outside is not."""
    return np.logical_and.reduce([shifted(mask, -dy, -dx) for dy, dx in shape])


def reached(seeds: np.ndarray, allowed: np.ndarray, shape: list[tuple[int, int]], rounds: int | None = None) -> np.ndarray:
    """What the seeds reach in steps of the shape through allowed cells."""
    grown = seeds.copy()
    while rounds is None or rounds > 0:
        new = (dilated(grown, shape) & allowed) | seeds
        if (new == grown).all():
            break
        grown, rounds = new, None if rounds is None else rounds - 1
    return grown


def holes_filled(mask: np.ndarray) -> np.ndarray:
    """Sets what is not set and can't be reached from the border in steps along rows and columns."""
    border = np.zeros_like(mask)
    border[[0, -1], :] = border[:, [0, -1]] = True
    return ~reached(border & ~mask, ~mask, disk(1))


def large_components(mask: np.ndarray, least: int) -> np.ndarray:
    """The cells of components, along rows and columns, of ``least`` cells or more."""
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        best = number.copy()
        for dy, dx in disk(1):
            best = np.maximum(best, shifted(number, dy, dx))
        best = np.where(mask, best, 0)
        best = np.where(mask, best.ravel()[np.maximum(best - 1, 0)], 0)  # a label points to a cell of the same component
        if (best == number).all():
            break
        number = best
    return mask & (np.bincount(number.ravel())[number] >= least)


def nearest(mask: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell the squared distance (in cells) to the nearest set cell, and its row and column (ties to the lower column).

    Within each column first, then from column to column until none further off
    can be nearer.  With a limit, cells further than it may get a greater
    distance than theirs, never a smaller one.
    """
    ny, nx = mask.shape
    rows, far = np.arange(ny, dtype=np.int64)[:, None], 4 * ny + 4 * nx
    above = np.maximum.accumulate(np.where(mask, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, 2 * far)[::-1], axis=0)[::-1]
    up, down = rows - above, below - rows
    own, gap = np.where(up <= down, above, below), np.minimum(np.minimum(up, down), far) ** 2
    d2, iy, ix = gap.copy(), own.copy(), np.broadcast_to(np.arange(nx), mask.shape).copy()
    for step in range(1, nx):
        if step * step > d2.max() or (limit is not None and step > limit):
            break
        for from_left in (True, False):
            here, there = (slice(step, None), slice(None, -step)) if from_left else (slice(None, -step), slice(step, None))
            total = gap[:, there] + step * step
            nearer = (total < d2[:, here]) | ((total == d2[:, here]) & from_left)
            d2[:, here] = np.where(nearer, total, d2[:, here])
            iy[:, here] = np.where(nearer, own[:, there], iy[:, here])
            ix[:, here] = np.where(nearer, np.arange(nx)[there], ix[:, here])
    if limit is not None:
        iy, ix = np.where(d2 <= limit * limit, iy, 0), np.where(d2 <= limit * limit, ix, 0)
    return d2, iy, ix


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian cut at four sigmas, the raster mirrored at its edges (the edge cell twice)."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = values.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        n = out.shape[axis]
        out = sum(w * np.take(padded, range(k, k + n), axis=axis) for k, w in enumerate(weights))
    return out


def slope(z: np.ndarray, cell: float) -> np.ndarray:
    parts = [np.gradient(z, cell, axis=a) if z.shape[a] > 1 else np.zeros_like(z) for a in (0, 1)]
    return np.sqrt(parts[0] ** 2 + parts[1] ** 2)


def cells(xy: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    low, high = xy.min(axis=0), xy.max(axis=0)
    nx, ny = (np.ceil((high - low) / cell) + 1).astype(int)
    ix, iy = np.minimum(((xy - low) / cell).astype(int), [nx - 1, ny - 1]).T
    return iy, ix, (ny, nx)


def embankment(xyz: np.ndarray, seeds: np.ndarray, c: EmbankmentConfig) -> np.ndarray:
    """Which points of a tile are embankment: a raster mask grown from the seed points, refined, and read at the points."""
    if seeds.all() or not seeds.any():
        return np.zeros(len(xyz), bool)
    iy, ix, shape = cells(xyz[:, :2], c.grid_cell_size)
    z = np.full(shape, -np.inf)
    np.maximum.at(z, (iy, ix), xyz[:, 2])
    _, ny, nx = nearest(np.isfinite(z))
    z = gaussian(z[ny, nx], 3.0)
    tracks = np.zeros(shape, bool)
    tracks[iy[seeds], ix[seeds]] = True
    d2, ty, tx = nearest(tracks, int(np.ceil(c.max_dist_m / c.grid_cell_size)) + 1)
    distance, track_z, steep = np.sqrt(d2) * c.grid_cell_size, z[ty, tx], slope(z, c.grid_cell_size)
    flank = (
        (steep >= c.min_slope) & (steep <= c.max_slope) & (z >= track_z - c.max_embankment_height) & (z <= track_z + c.max_elev_diff)
        & ((track_z - z) / (distance + 1e-6) >= c.min_global_slope)
    )
    valid = ((distance <= c.crown_width_m) | flank) & (distance <= c.max_dist_m)
    grown = reached(tracks, valid, SQUARE, int(c.max_dist_m / c.grid_cell_size) + 5)
    found = refined(xyz[grown[iy, ix], :2], xyz[:, :2], c) | seeds
    return found


def refined(inside: np.ndarray, all_xy: np.ndarray, c: EmbankmentConfig) -> np.ndarray:
    """The mask of points found, closed, its holes filled, opened, without small components, and read at all points."""
    if len(inside) == 0:
        return np.zeros(len(all_xy), bool)
    low = all_xy.min(axis=0)
    _, _, shape = cells(all_xy, c.grid_cell_size)
    at = lambda xy: np.minimum(((xy - low) / c.grid_cell_size).astype(int), np.array(shape)[::-1] - 1).T
    mask = np.zeros(shape, bool)
    ix, iy = at(inside)
    mask[iy, ix] = True
    closing, opening = disk(c.closing_radius), disk(c.erosion_radius)
    mask = holes_filled(eroded(dilated(mask, closing), closing))
    mask = large_components(dilated(eroded(mask, opening), opening), c.min_cluster_size)
    ix, iy = at(all_xy)
    return mask[iy, ix]
