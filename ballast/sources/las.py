"""LAS files as a Spark data source: scene_id, point_id, x, y, z, label.

Register ``LasDataSource`` and read with ``spark.read.format("las").load(path)``.
The public header and the first 20 bytes of the point record (formats 0 to 10)
are decoded; compressed LAZ is not supported.  A file is read in slices of
points, so that one large file spreads over tasks.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE = 1_000_000


@dataclass
class Header:
    offset: int
    record: int
    count: int
    kind: int
    scale: tuple[float, float, float]
    origin: tuple[float, float, float]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    minor = raw[25]
    offset, = struct.unpack_from("<I", raw, 96)
    kind, record, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError(f"{path} is compressed")
    if minor >= 4:
        count, = struct.unpack_from("<Q", raw, 247)
    numbers = struct.unpack_from("<6d", raw, 131)
    return Header(offset, record, count, kind, numbers[:3], numbers[3:])


def read_points(path: str, header: Header, start: int, stop: int) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        f.seek(header.offset + start * header.record)
        raw = np.frombuffer(f.read((stop - start) * header.record), np.uint8).reshape(-1, header.record)
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4")
    label = raw[:, 16] if header.kind >= 6 else raw[:, 15] & 0x1F
    return {a: xyz[:, k] * header.scale[k] + header.origin[k] for k, a in enumerate("xyz")} | {"label": label.astype(np.int16)}


@dataclass
class Slice(InputPartition):
    path: str
    scene: int
    start: int
    stop: int


class LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.files = sorted(glob.glob(os.path.join(path, "*.las"))) if os.path.isdir(path) else sorted(glob.glob(path))

    def partitions(self):
        return [Slice(p, k, s, min(s + SLICE, h.count)) for k, p in enumerate(self.files) for h in [read_header(p)] for s in range(0, h.count, SLICE)]

    def read(self, part: Slice):
        found = read_points(part.path, read_header(part.path), part.start, part.stop)
        n = part.stop - part.start
        columns = [pa.array(np.full(n, part.scene)), pa.array(np.arange(part.start, part.stop)), *(pa.array(found[a]) for a in "xyz"), pa.array(found["label"])]
        yield pa.RecordBatch.from_arrays(columns, ["scene_id", "point_id", "x", "y", "z", "label"])


class LasDataSource(DataSource):
    """A file or folder of LAS files; scene_id counts the files in order of their names."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return "scene_id long, point_id long, x double, y double, z double, label short"

    def reader(self, schema):
        return LasReader(self.options["path"])
