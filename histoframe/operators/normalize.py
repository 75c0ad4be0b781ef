"""Normalisation of marker means, long form: one aggregation of statistics a marker, broadcast, then a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoframe.functions.columns import yeo_johnson


def _z(rows: DataFrame, column: str = "v") -> DataFrame:
    """(cell_id, marker, value): v less its mean by its population deviation; 0 for a constant marker."""
    stats = rows.groupBy("marker").agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    joined = rows.join(F.broadcast(stats), "marker")  # one row a marker
    return joined.select("cell_id", "marker", F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise(0.0).alias("value"))


def _values(cell_marker: DataFrame) -> DataFrame:
    return cell_marker.select("cell_id", "marker", F.nanvl(F.col("mean").cast("double"), F.lit(None)).alias("v"))


def zscore(cell_marker: DataFrame) -> DataFrame:
    return _z(_values(cell_marker))


def minmax(cell_marker: DataFrame) -> DataFrame:
    """Scaled to 0..1; a constant marker becomes 0."""
    rows = _values(cell_marker)
    stats = rows.groupBy("marker").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    width = F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(1.0)
    return rows.join(F.broadcast(stats), "marker").select("cell_id", "marker", ((F.col("v") - F.col("_a")) / width).alias("value"))


def arcsinh(cell_marker: DataFrame, cofactor: float = 5.0) -> DataFrame:
    """asinh(x / cofactor), then z-scores."""
    return _z(_values(cell_marker).withColumn("v", F.asinh(F.col("v") / cofactor)))


def log_zscore(cell_marker: DataFrame, skewness_threshold: float = 1.0) -> DataFrame:
    """log1p of the markers whose skewness exceeds the threshold in size, then z-scores of all."""
    rows = _values(cell_marker)
    stats = rows.groupBy("marker").agg(F.skewness("v").alias("_k"))
    skewed = F.abs(F.coalesce(F.nanvl(F.col("_k"), F.lit(0.0)), F.lit(0.0))) > skewness_threshold
    return _z(rows.join(F.broadcast(stats), "marker").withColumn("v", F.when(skewed, F.log1p(F.greatest("v", F.lit(-1 + 1e-12)))).otherwise(F.col("v"))))


def _likelihood(lam: Column) -> Column:
    n = F.count("v")
    variance = F.var_pop(yeo_johnson(F.col("v"), lam))
    return -n / 2.0 * F.ln(F.nullif(variance, F.lit(0.0))) + (F.first(lam) - 1) * F.sum(F.signum("v") * F.log1p(F.abs("v")))


def yeo_johnson_lambdas(cell_marker: DataFrame, rounds: int = 4, reach: float = 4.0, points: int = 17) -> DataFrame:
    """(marker, lam): the likeliest parameter. Each round evaluates a grid for all markers in one pass, then narrows it."""
    rows = _values(cell_marker).where("v is not null")
    spark = cell_marker.sparkSession
    best = {r.marker: 1.0 for r in rows.select("marker").distinct().collect()}  # one row a marker
    for _ in range(rounds):
        grid = np.linspace(-reach, reach, points)
        centres = F.broadcast(spark.createDataFrame(list(best.items()) or [("", 1.0)], "marker string, centre double"))
        scores = rows.join(centres, "marker").groupBy("marker").agg(*(_likelihood(F.col("centre") + float(d)).alias(f"d{k}") for k, d in enumerate(grid)))
        for r in scores.collect():
            found = [(r[f"d{k}"], -abs(d), d) for k, d in enumerate(grid) if r[f"d{k}"] is not None and r[f"d{k}"] == r[f"d{k}"]]
            if found:
                best[r.marker] += float(max(found)[2])
        reach = 2 * reach / (points - 1)
    return spark.createDataFrame(list(best.items()) or [], "marker string, lam double")


def yeo_johnson_zscore(cell_marker: DataFrame) -> DataFrame:
    """Yeo-Johnson with the likeliest parameter of each marker, then z-scores; constant markers become 0."""
    rows = _values(cell_marker)
    return _z(rows.join(F.broadcast(yeo_johnson_lambdas(cell_marker)), "marker").withColumn("v", yeo_johnson(F.col("v"), F.col("lam"))))


METHODS = {"none": lambda c: _values(c).withColumnRenamed("v", "value"), "zscore": zscore, "minmax": minmax, "arcsinh": arcsinh, "log_zscore": log_zscore, "yeo_johnson": yeo_johnson_zscore}


def normalize(cell_marker: DataFrame, method: str = "zscore", **options: float) -> DataFrame:
    """(cell_id, marker, value) by a named method."""
    return METHODS[method](cell_marker, **options)


def to_vectors(values: DataFrame, markers: list[str], value: str = "value") -> DataFrame:
    """(cell_id, vector): the markers of a cell in the order of the list; a missing one is 0."""
    wide = [F.coalesce(F.max(F.when(F.col("marker") == m, F.nanvl(F.col(value), F.lit(0.0)))), F.lit(0.0)) for m in markers]
    return values.groupBy("cell_id").agg(F.array(*wide).alias("vector"))
