"""Shapes in Parquet: a column of well-known binary (polygons and multipolygons) and a column of bounding boxes.

The boxes are plain numbers, so a filter on them reaches the scan and skips row groups; only the shapes that are left
are decoded, in Arrow batches.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finegrid.operators.geometry import with_shape

POLYGON, MULTIPOLYGON = 3, 6
#: Flags of the extended form: a third and a fourth coordinate, and a reference system in front.
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def decode(data: bytes) -> list[list[np.ndarray]]:
    """Polygons, each a list of rings of (x, y) rows; further coordinates are dropped, either byte order is read."""
    at = 0

    def geometry() -> list[list[np.ndarray]]:
        nonlocal at
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5 + (4 if kind & HAS_SRID else 0)
        width = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
        kind = (kind & 0xFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == MULTIPOLYGON:
            return [polygon for _ in range(n) for polygon in geometry()]
        if kind != POLYGON:
            raise ValueError(f"a shape is a polygon or a multipolygon, not type {kind}")
        rings = []
        for _ in range(n):
            (points,) = struct.unpack_from(order + "I", data, at)
            rings.append(np.frombuffer(data, order + "f8", points * width, at + 4).reshape(points, width)[:, :2].astype(float))
            at += 4 + 8 * width * points
        return [rings]

    return geometry()


def encode(polygons: list[list[np.ndarray]]) -> bytes:
    """Little-endian; one polygon as POLYGON, else MULTIPOLYGON; rings are closed."""
    parts = []
    for rings in polygons:
        out = [struct.pack("<BII", 1, POLYGON, len(rings))]
        for ring in rings:
            closed = ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])
            out += [struct.pack("<I", len(closed)), np.ascontiguousarray(closed, "<f8").tobytes()]
        parts.append(b"".join(out))
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(parts)


def _nested(shapes: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """Decoded shapes as one nested Arrow array, by offsets."""
    starts = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    polygons = [p for s in shapes if s is not None for p in s]
    rings = [r for p in polygons for r in p]
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    by_ring = pa.ListArray.from_arrays(starts([len(r) for r in rings]), xy)
    by_polygon = pa.ListArray.from_arrays(starts([len(p) for p in polygons]), by_ring)
    return pa.ListArray.from_arrays(starts([0 if s is None else len(s) for s in shapes]), by_polygon, mask=pa.array([s is None for s in shapes], pa.bool_()))


def _unnested(column: pa.Array) -> list[bytes | None]:
    """Well-known binary of a nested Arrow array of shapes."""
    out: list[bytes | None] = []
    for shape in column:
        if not shape.is_valid:
            out.append(None)
            continue
        polygons = []
        for polygon in shape.values:
            points = [(ring.values.field("x"), ring.values.field("y")) for ring in polygon.values]
            polygons.append([np.column_stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)]) for x, y in points])
        out.append(encode(polygons))
    return out


def _replaced(df: DataFrame, column: str, into: str, kind: str, make) -> DataFrame:
    """``df`` with ``column`` made into ``into`` batch by batch."""
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(into, T._parse_datatype_string(kind)) if i == at else f for i, f in enumerate(df.schema.fields)])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([make(c) if i == at else c for i, c in enumerate(part.columns)], schema.names)

    return df.mapInArrow(run, schema)


def write_shapes(df: DataFrame, path: str, ring: str, geometry: str = "geometry", bbox: str = "bbox") -> None:
    """``df`` as Parquet with its shapes in ``geometry`` (well-known binary) and their boxes in ``bbox``.

    Rows are laid out by the box's corner, so row groups hold neighbours and a filter on boxes skips the others.  A
    null or empty shape has a null box.
    """
    df = with_shape(df, ring).withColumn(ring, F.col(ring).cast(SHAPE))
    points = F.flatten(F.flatten(F.col(ring)))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    boxed = df.withColumn(bbox, F.when(F.size(points) > 0, box)).repartitionByRange(F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin")).sortWithinPartitions(F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin"))
    _replaced(boxed, ring, geometry, "binary", lambda c: pa.array(_unnested(c), pa.binary())).write.parquet(path)


def boxed(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, bbox: str = "bbox") -> DataFrame:
    """The rows as they are stored, of those whose box meets ``box`` (west, south, east, north) only."""
    df = spark.read.parquet(path)
    if box is None:
        return df
    west, south, east, north = box
    return df.where((F.col(f"{bbox}.xmin") <= east) & (F.col(f"{bbox}.xmax") >= west) & (F.col(f"{bbox}.ymin") <= north) & (F.col(f"{bbox}.ymax") >= south))


def read_shapes(spark: SparkSession, path: str, geometry: str = "geometry", shape: str = "shape", box: tuple[float, float, float, float] | None = None, bbox: str = "bbox") -> DataFrame:
    """Rows with their shapes decoded into ``shape`` (polygons of rings of points); ``box`` prunes at the scan."""
    decoded = lambda c: _nested([None if v is None else decode(v) for v in c.to_pylist()])
    rows = boxed(spark, path, box, bbox)
    return _replaced(rows.drop(bbox) if bbox in rows.columns else rows, geometry, shape, SHAPE, decoded)
