"""Per-cell measures: marker means, geometry, channel ranges, counts and the cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoframe.operators.ranks import percentiles
from histoframe.operators.runs import images


def cell_means(pixels: DataFrame, keys: tuple[str, ...] = ("cell_id", "marker"), value: str = "value") -> DataFrame:
    """Count, sum and mean of a value per cell and marker; label 0 and null labels are background. Partial sums first."""
    v = F.col(value).cast("double")
    return pixels.where(F.coalesce(F.col(keys[0]) != 0, F.lit(False))).groupBy(*keys).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"))


def cell_means_wide(rows: DataFrame, cell: str, channels: dict[str, str]) -> DataFrame:
    """One row a cell with the mean of each channel column, from rows that hold all channels: a single aggregation."""
    means = [F.avg(F.col(source).cast("double")).alias(f"{name}_mean") for name, source in channels.items()]
    return rows.groupBy(F.col(cell).alias("cell_id")).agg(F.count("*").alias("area_px"), *means)


def widen(cell_marker: DataFrame, markers: list[str], keys: tuple[str, ...] = ("cell_id",), value: str = "mean", suffix: str = "_mean") -> DataFrame:
    """Long to wide by an explicit marker list; a marker that a cell lacks is null."""
    columns = [F.max(F.when(F.col("marker") == m, F.col(value))).alias(f"{m}{suffix}") for m in markers]
    return cell_marker.groupBy(*keys).agg(*columns)


def cell_geometry(runs: DataFrame) -> DataFrame:
    """Area, centroid (pixel indices) and bounding box (ends exclusive) per image, mask and label, from label runs."""
    n = F.col("x1") - F.col("x0")
    area = F.sum(n)
    return (
        runs.where("label > 0 and x1 > x0")
        .groupBy(*images(runs), "mask_id", F.col("label").alias("cell_id"))
        .agg(
            area.cast("long").alias("area_px"),
            (F.sum((F.col("x0") + F.col("x1") - 1) / 2.0 * n) / area).alias("x_px"),
            (F.sum(F.col("y").cast("double") * n) / area).alias("y_px"),
            F.min("y").alias("ymin"),
            F.min("x0").alias("xmin"),
            (F.max("y") + 1).alias("ymax"),
            F.max("x1").alias("xmax"),
        )
    )


def to_microns(cells: DataFrame, pixel_size: float | None) -> DataFrame:
    """Adds x_um, y_um and area_um2 where the pixel size is positive."""
    if not pixel_size or pixel_size <= 0:
        return cells
    return cells.withColumns({"x_um": F.col("x_px") * pixel_size, "y_um": F.col("y_px") * pixel_size, "area_um2": F.col("area_px") * pixel_size**2})


def channel_maxima(pixels: DataFrame, key: str = "marker", value: str = "value") -> DataFrame:
    """Largest value per channel, NaN left out; 1.0 where nothing positive and finite is there."""
    v = F.col(value).cast("double")
    top = F.max(F.when(~F.isnan(v), v))
    return pixels.groupBy(key).agg(F.when((top > 0) & (top < float("inf")), top).otherwise(1.0).alias("data_max"))


def value_range(pixels: DataFrame, key: str = "marker", value: str = "value") -> DataFrame:
    """Least and largest value per channel."""
    return pixels.groupBy(key).agg(F.min(value).alias("data_min"), F.max(value).alias("data_max"))


def percentile_range(pixels: DataFrame, low: float = 5, high: float = 95, key: str = "marker", value: str = "value", exact: bool = True) -> DataFrame:
    """Percentiles per channel; least and largest value where both are equal. `exact=False` sketches instead of sorting."""
    v = F.col(value).cast("double")
    ends = pixels.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    both = percentiles(pixels, [low / 100, high / 100], key, value) if exact else pixels.groupBy(key).agg(F.percentile_approx(v, [low / 100, high / 100], 10_000).alias("p"))
    found = ends.join(both, key)
    flat = F.col("p")[0] == F.col("p")[1]
    return found.select(key, F.when(flat, F.col("_lo")).otherwise(F.col("p")[0]).alias("range_min"), F.when(flat, F.col("_hi")).otherwise(F.col("p")[1]).alias("range_max"))


def filter_mean(cells: DataFrame, cell_marker: DataFrame, marker: str, threshold: float) -> DataFrame:
    """Cells whose mean of a marker is at least a threshold, which only counts above the marker's least value."""
    own = cell_marker.where(F.col("marker") == marker)
    least = own.agg(F.min("mean").alias("_least"))  # one row
    keep = own.crossJoin(F.broadcast(least)).where((F.lit(threshold) <= F.col("_least")) | (F.col("mean") >= threshold)).select("cell_id")
    return cells.join(keep, "cell_id", "left_semi")


def positive_counts(cell_marker: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per marker: cells at or above the threshold, and cells with a mean above zero."""
    joined = cell_marker.join(F.broadcast(thresholds.select("marker", "threshold")), "marker")  # one row a marker
    return joined.groupBy("marker").agg(F.count_if(F.col("mean") >= F.col("threshold")).alias("n_positive"), F.count_if(F.col("mean") > 0).alias("n_with_signal"))


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones every time: the first by a hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def stride_sample(pixels: DataFrame, n_values: int, most: int = 1_000_000) -> DataFrame:
    """Every s-th row and column of pixels, s = int(sqrt(n / most)), where there are more than `most` values."""
    step = int((n_values / most) ** 0.5) if n_values > most else 1
    return pixels if step < 2 else pixels.where((F.col("y") % step == 0) & (F.col("x") % step == 0))


def cell_table(cells: DataFrame, cell_marker: DataFrame, markers: list[str], positivity: DataFrame | None = None, clusters: DataFrame | None = None, types: DataFrame | None = None, names: DataFrame | None = None, pixel_size: float | None = None) -> DataFrame:
    """The export table: geometry, microns, cluster and its name, phenotype, and mean and positive flag of each marker.

    Of a cell's types the last by type_ord is its phenotype, `Unknown` without one. Clusters are named `Cluster k`, by the
    user's names, or `Noise` (-1). A missing mean is null and not positive. Columns of a marker stand together.
    """
    out = to_microns(cells, pixel_size)
    if clusters is not None:
        label = F.when(F.col("cluster_id") == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id")))
        own = clusters.select("cell_id", "cluster_id")
        if names is not None:
            own = own.join(F.broadcast(names.select("cluster_id", "name")), "cluster_id", "left").withColumn("cluster_name", F.coalesce("name", label)).drop("name")
        else:
            own = own.withColumn("cluster_name", label)
        out = out.join(own, "cell_id", "left")
    if types is not None:
        last = types.groupBy("cell_id").agg(F.max_by("cell_type", "type_ord").alias("phenotype"))
        out = out.join(last, "cell_id", "left").withColumn("phenotype", F.coalesce("phenotype", F.lit("Unknown")))
    out = out.join(widen(cell_marker, markers), "cell_id", "left")
    if positivity is not None:
        flags = positivity.withColumn("flag", F.col("state") == 2)
        out = out.join(widen(flags, markers, value="flag", suffix="_positive"), "cell_id", "left").fillna(False, [f"{m}_positive" for m in markers])
    ends = ("_mean", "_positive") if positivity is not None else ("_mean",)
    marker_columns = [f"{m}{e}" for m in markers for e in ends]
    return out.select(*(c for c in out.columns if c not in marker_columns), *marker_columns)


def probe(pixels: DataFrame, runs: DataFrame, x: int, y: int, marker: str) -> DataFrame:
    """Value of a marker and labels at a pixel; no row outside the image."""
    value = pixels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("marker") == marker)).select("value")
    label = runs.where((F.col("y") == y) & (F.col("x0") <= x) & (F.col("x1") > x)).select("mask_id", "label")
    return value.join(label, how="left", on=F.lit(True))  # one row against one row a mask


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def raw_markers(channels: DataFrame) -> DataFrame:
    """Channels that thresholds are computed for: originals."""
    return channels.where(kind_is("original"))


def ai_markers(channels: DataFrame) -> DataFrame:
    """Channels that a positivity model may score: no masks, and stored in the image."""
    return channels.where(~kind_is("mask", "cell_mask", "type_mask", "region") & (F.col("channel_idx") >= 0))


def cluster_channels(channels: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Channels that clustering uses: originals and derived ones, all if none is selected."""
    found = channels.where(kind_is("original", "derived"))
    return found.where(F.col("name").isin(selected)) if selected else found


def rule_markers(channels: DataFrame) -> DataFrame:
    """Channels that can stand in a rule table: everything but masks and regions."""
    return channels.where(~kind_is("mask", "cell_mask", "type_mask", "region"))
