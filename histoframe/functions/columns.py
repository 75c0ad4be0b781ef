"""Column expressions: scalars, names, natural order and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers and letters ignore case; null stays null."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def coverage(value: Column, data_min: Column, data_max: Column, range_min: Column, range_max: Column) -> Column:
    """Share of full display strength: the value scaled to the data range, then to the chosen range; a step if that is empty."""
    span = data_max - data_min
    scaled = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - data_min) / F.nullif(span, F.lit(0.0))))).otherwise(F.lit(0.0))
    width = range_max - range_min
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (scaled - range_min) / F.nullif(width, F.lit(0.0))))
    return F.when(width > 0, inside).otherwise(F.when(scaled >= range_max, 1.0).otherwise(0.0))


def clean_name(name: Column) -> Column:
    """Characters other than letters, digits, _, . and - become _; outer _ go; empty names become `element`."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit("element")).otherwise(safe)


def safe_names(names: DataFrame, column: str, order: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """Adds `safe_name`: the cleaned name, with _1, _2 and so on for further rows that clean to the same one.

    Numbers that meet another cleaned name get one more suffix, so names are unique in a partition.
    """
    base = names.withColumn("_base", clean_name(F.col(column)))
    place = F.row_number().over(Window.partitionBy(*partition, "_base").orderBy(order)) - 1
    named = base.withColumn("_place", place).withColumn("safe_name", F.when(F.col("_place") == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_place")))
    again = F.row_number().over(Window.partitionBy(*partition, "safe_name").orderBy(order)) - 1
    return named.withColumn("safe_name", F.when(again == 0, F.col("safe_name")).otherwise(F.concat_ws("_", "safe_name", again))).drop("_base", "_place")


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring of (x, y) structs, open or closed; null rings and points give false."""

    def crosses(inside: Column, k: Column) -> Column:
        p, q = F.get(ring, k - 1), F.get(ring, F.when(k < F.size(ring), k).otherwise(F.lit(0)))
        edge = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return inside != F.coalesce(edge & (x < at), F.lit(False))

    tested = F.aggregate(F.sequence(F.lit(1), F.size(ring)), F.lit(False), crosses)
    return F.coalesce(F.when(F.size(ring) >= 3, tested), F.lit(False))


def bounding_box(ring: Column) -> Column:
    """(x0, y0, x1, y1) of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def closed_ring(ring: Column) -> Column:
    """The ring with its first point at the end too."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def open_ring(ring: Column) -> Column:
    """The ring without a repeated last point."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when((F.size(ring) > 1) & (first == last), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def in_region_group(name: Column, group: str) -> Column:
    """Whether a region's name is the group's, or starts with it and a space; case is ignored."""
    low = F.lower(F.trim(name))
    return (low == group.lower()) | low.startswith(f"{group.lower()} ")


def share(part: Column, whole: Column) -> Column:
    """part / whole, NaN where the whole is zero."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / F.nullif(whole, F.lit(0)))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson transform of x with parameter lam."""
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.nullif(lam, F.lit(0.0)))
    rest = 2 - lam
    down = F.when(F.abs(rest) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, rest) - 1) / F.nullif(rest, F.lit(0.0)))
    return F.when(x >= 0, up).otherwise(down)
