"""Polygons as well-known binary in Parquet, with the metadata that marks the file as GeoParquet."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoframe.scratch import open_fs

POLYGON, MULTI = 3, 6


def rings_of(wkb: bytes) -> list[list[tuple[float, float]]]:
    """Outer rings of a Polygon or MultiPolygon, repeated end points left off; other kinds give none."""
    order = "<" if wkb[0] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", wkb, 1)
    kind %= 1000
    if kind not in (POLYGON, MULTI):
        return []
    out, at = [], 9
    for _ in range(n if kind == MULTI else 1):
        if kind == MULTI:
            order = "<" if wkb[at] == 1 else ">"
            (rings,) = struct.unpack_from(f"{order}I", wkb, at + 5)
            at += 9
        else:
            rings = n
        for k in range(rings):
            (points,) = struct.unpack_from(f"{order}I", wkb, at)
            values = np.frombuffer(wkb, f"{order}f8", 2 * points, at + 4).reshape(-1, 2).tolist()
            at += 4 + 16 * points
            if k == 0:
                ring = [tuple(p) for p in values]
                out.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    return out


def wkb_of(rings: list[list[tuple[float, float]]]) -> bytes:
    """A Polygon for one ring, a MultiPolygon for more; rings are closed."""

    def polygon(ring) -> bytes:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        return struct.pack("<BIII", 1, POLYGON, 1, len(closed)) + np.array(closed, "<f8").tobytes()

    return polygon(rings[0]) if len(rings) == 1 else struct.pack("<BII", 1, MULTI, len(rings)) + b"".join(map(polygon, rings))


def read_shapes(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """All columns but the geometry, with part and ring; rings of fewer than three points are dropped."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != column]
    schema = rows.select(*rest).withColumns({"part": F.lit(0), "ring": F.expr("cast(null as array<struct<x:double,y:double>>)")}).schema
    ring_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, parts, rings = [], [], []
            for k, wkb in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                valid = [r for r in rings_of(wkb) if len(r) >= 3] if wkb else []
                take += [k] * len(valid)
                parts += range(len(valid))
                rings += [[{"x": x, "y": y} for x, y in r] for r in valid]
            kept = batch.slice(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(parts, pa.int32()), pa.array(rings, ring_type)], [*rest, "part", "ring"])

    return rows.select(*rest, column).mapInArrow(decode, schema)


def write_shapes(regions: DataFrame, path: str) -> None:
    """(name, part, ring) as GeoParquet files, one a task; the parts of a name are one geometry."""
    geo = json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"]}}})
    grouped = regions.where(F.size("ring") >= 3).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ring"))), lambda s: s["ring"]).alias("rings"))

    def put(rows) -> None:
        found = [(r.name, wkb_of([[(p.x, p.y) for p in ring] for ring in r.rings])) for r in rows]
        if found:
            names, shapes = zip(*found, strict=True)
            table = pa.table({"name": pa.array(names), "geometry": pa.array(shapes, pa.binary())}).replace_schema_metadata({"geo": geo})
            file_system, folder = open_fs(path)
            file_system.create_dir(folder, recursive=True)
            # Named by the partition and moved into place whole: a second attempt writes the same file again.
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}.parquet"
            aside = f"{folder}/.{uuid.uuid4().hex}.tmp"
            pq.write_table(table, aside, filesystem=file_system)
            file_system.move(aside, name)

    grouped.foreachPartition(put)
