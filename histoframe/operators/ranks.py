"""Exact ranks without gathering a channel's values in one task.

Rows: distinct values with their counts are sorted by ranges, and totals of ranges say where a rank lies. Tiles: values
as bit strings of the same order; a histogram of the leading bits, made inside tile tasks, says which bits a rank begins
with, and further passes look at the pixels that begin so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoframe.operators.planes import PLANE, each_row, plane_of
from histoframe.scratch import Scratch

_SIGN = np.uint64(1 << 63)
#: Types whose values a 32-bit float holds exactly.
NARROW = ("float16", "float32", "int8", "uint8", "int16", "uint16", "bool")


def sorted_counts(rows: DataFrame, key: str, value: str, scratch: Scratch) -> DataFrame:
    """(key, v, c, _part): distinct values with counts, in the order of key and value by range partitions; a written table."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    return scratch.table(counts.repartitionByRange(key, "v").withColumn("_part", F.spark_partition_id()), "sorted")


def percentiles(rows: DataFrame, shares: list[float], key: str, value: str) -> DataFrame:
    """(key, p): exact percentiles, between two ranks by linear interpolation; shares from 0 to 1. Nulls are left out."""
    scratch = Scratch(rows.sparkSession, "percentiles")
    found = sorted_counts(rows, key, value, scratch)
    totals = found.groupBy(key, "_part").agg(F.sum("c").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("_part")) - F.col("n")  # a row a partition
    totals = scratch.table(totals.select(key, "_part", "n", before.alias("base")), "totals")
    wants = _wanted(totals.groupBy(key).agg(F.sum("n").alias("n")), [key], shares)
    here = totals.join(wants, key).where("k >= base and k < base + n").select(key, "_part", "base", "want", "k")
    here = scratch.table(here, "wanted")
    near = found.join(here.select(key, "_part", "base").distinct(), [key, "_part"])
    upto = F.col("base") + F.sum("c").over(Window.partitionBy(key, "_part").orderBy("v"))
    near = near.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
    hit = near.join(here.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "want", "k"), (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p"))).where("k >= from and k < upto")
    return _between(hit.select(key, "want", "v"), totals.groupBy(key).agg(F.sum("n").alias("n")), [key], shares)


def _wanted(sizes: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, want, k): the two ranks on either side of each share; want numbers them."""
    at = [F.floor((F.col("n") - 1) * F.lit(s)) for s in shares]
    ranks = [F.struct(F.lit(2 * j + d).alias("want"), F.least(a + d, F.col("n") - 1).cast("long").alias("k")) for j, a in enumerate(at) for d in (0, 1)]
    return sizes.where("n > 0").select(*keys, F.explode(F.array(*ranks)).alias("w")).select(*keys, "w.want", "w.k")


def _between(hit: DataFrame, sizes: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """The percentiles from the values at their ranks."""
    values = hit.groupBy(*keys).agg(*(F.max(F.when(F.col("want") == w, F.col("v"))).alias(f"v{w}") for w in range(2 * len(shares))))
    p = []
    for j, s in enumerate(shares):
        at, low, high = (F.col("n") - 1) * F.lit(s), F.col(f"v{2 * j}"), F.col(f"v{2 * j + 1}")
        over = at - F.floor(at)
        p.append(F.when((over == 0) | (low == high), low).otherwise((1 - over) * low + over * high))
    return values.join(sizes, keys).select(*keys, F.array(*p).alias("p"))


# ---- tiles


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the values; equal for both zeros."""
    raw = (values.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(raw & _SIGN, ~raw, raw | _SIGN)


def values_of_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)


def _digits(tiles: DataFrame, shift: int, size: int) -> DataFrame:
    """(plane, prefix, digit, c, wide): of pixels whose bits before the digit are one of the plane's `starts`."""
    asked = "starts" in tiles.columns
    names = ["image_id", "channel_idx", "prefix", "digit", "c", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                bits = ordered_bits(plane_of(r).ravel())
                before = bits >> np.uint64(shift + size) if asked else np.zeros(len(bits), np.uint64)
                digit = bits >> np.uint64(shift) & np.uint64((1 << size) - 1)
                for start in r["starts"] if asked else [0]:
                    found, counts = np.unique(digit[before == np.uint64(start)], return_counts=True)
                    n = len(found)
                    columns = [pa.array([r["image_id"]] * n, pa.string()), pa.array(np.full(n, r["channel_idx"], np.int32)), pa.array(np.full(n, start, np.int64)), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array([r["dtype"] not in NARROW] * n, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    counted = tiles.mapInArrow(run, "image_id string, channel_idx int, prefix long, digit long, c long, wide boolean")
    return counted.groupBy(*PLANE, "prefix", "digit").agg(F.sum("c").alias("c"), F.max("wide").alias("wide"))


def tile_percentiles(tiles: DataFrame, shares: list[float]) -> DataFrame:
    """(image_id, channel_idx, p): exact percentiles of all pixels of each channel of an image; a written table.

    Two passes over the tiles where 32-bit floats hold all pixels, else three. NaN is the greatest value.
    """
    scratch = Scratch(tiles.sparkSession, "tile-percentiles")
    plain = tiles.where("h > 0 and w > 0").select(*PLANE, "h", "w", "dtype", "pixels")
    counts = scratch.table(_digits(plain, 48, 16), "counts-48")
    sizes = scratch.table(counts.groupBy(*PLANE).agg(F.sum("c").alias("n")), "sizes")
    wants = _wanted(sizes, PLANE, shares).withColumn("prefix", F.lit(0).cast("long"))
    wide = counts.agg(F.max("wide")).first()[0]
    for size, left in ((16, 48), (24, 24), (24, 0)):
        if left < 48:
            starts = scratch.table(wants.groupBy(*PLANE).agg(F.collect_set("prefix").alias("starts")), f"starts-{left}")  # a few numbers a channel
            counts = scratch.table(_digits(plain.join(starts, PLANE), left, size), f"counts-{left}")
        upto = F.sum("c").over(Window.partitionBy(*PLANE, "prefix").orderBy("digit"))  # at most a row a digit
        placed = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
        hit = placed.join(wants, [*PLANE, "prefix"]).where("k >= from and k < upto")
        wants = scratch.table(hit.select(*PLANE, "want", (F.col("k") - F.col("from")).alias("k"), F.shiftleft("prefix", size).bitwiseOR(F.col("digit")).alias("prefix")), f"wants-{left}")
        if left == 24 and not wide:
            break

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(3).to_numpy().view(np.uint64)
            if not wide:  # the last bits of a narrow number are zeros, turned round where it is negative
                bits = bits << np.uint64(24)
                bits = np.where(bits & _SIGN, bits, bits | np.uint64((1 << 24) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values_of_bits(bits))], [*PLANE, "want", "v"])

    found = wants.select(*PLANE, "want", "prefix").mapInArrow(back, "image_id string, channel_idx int, want int, v double")
    return scratch.table(_between(found, sizes, PLANE, shares), "found")


def tile_range(tiles: DataFrame) -> DataFrame:
    """(image_id, channel_idx, lo, hi): the least and greatest finite pixel of each channel, by one row a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in each_row(batch):
                v = plane_of(r).astype(np.float64)
                v = v[np.isfinite(v)]
                if v.size:
                    rows.append((r["image_id"], r["channel_idx"], v.min(), v.max()))
            yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in rows], t) for k, (c, t) in enumerate((("image_id", pa.string()), ("channel_idx", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())))})

    found = tiles.select(*PLANE, "h", "w", "dtype", "pixels").mapInArrow(run, "image_id string, channel_idx int, lo double, hi double")
    return found.groupBy(*PLANE).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def tile_histogram(tiles: DataFrame, scratch: Scratch, bins: int = 256) -> DataFrame:
    """(image_id, channel_idx, lo, hi, bin, h, c): each channel's pixels in equal bins over its range, all bins, with centres."""
    ends = scratch.table(tile_range(tiles), "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                v = plane_of(r).astype(np.float64).ravel()
                v = v[np.isfinite(v)]
                width = r["hi"] - r["lo"]
                at = np.minimum(np.floor((v - r["lo"]) / width * bins), bins - 1).astype(np.int64) if width > 0 else np.zeros(len(v), np.int64)
                h = np.bincount(at, minlength=bins)
                found = np.flatnonzero(h)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * n, pa.string()), pa.array(np.full(n, r["channel_idx"], np.int32)), pa.array(found.astype(np.int32)), pa.array(h[found])], [*PLANE, "bin", "h"])

    counts = tiles.select(*PLANE, "h", "w", "dtype", "pixels").join(ends, PLANE).mapInArrow(run, "image_id string, channel_idx int, bin int, h long").groupBy(*PLANE, "bin").agg(F.sum("h").alias("h"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*PLANE, "bin"], "left").select(*PLANE, "lo", "hi", "bin", F.coalesce("h", F.lit(0)).alias("h"), centre.alias("c"))
