"""Rule tables, cell tables, bundles and result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str, channels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rules (type_ord, cell_type, marker, required) of a CSV matrix, and the markers (marker) left out, sorted.

    The header starts with `Marker`, else an error; + is 1, - is 2, anything else 0. Markers that aren't among the
    channels' names are left out.
    """
    table = spark.read.csv(path, header=True)
    if not table.columns or table.columns[0].strip().lower() != "marker":
        raise ValueError("a rule table starts with the column Marker")
    first, *types = table.columns
    names = {t: k for k, t in enumerate(types)}
    order = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    sign = F.trim(F.coalesce("_v", F.lit("")))
    if not types:
        rules = spark.createDataFrame([], "type_ord int, cell_type string, marker string, required int")
    else:
        long = table.select(F.trim(F.col(f"`{first}`")).alias("marker"), *(F.col(f"`{t}`") for t in types)).unpivot("marker", types, "cell_type", "_v")
        rules = long.select(order[F.col("cell_type")].alias("type_ord"), F.trim("cell_type").alias("cell_type"), "marker", F.when(sign == "+", 1).when(sign == "-", 2).otherwise(0).alias("required"))
    if channels is None:
        return rules, spark.createDataFrame([], "marker string")
    known = channels.select(F.col("name").alias("marker"))
    return rules.join(known, "marker", "left_semi").select("type_ord", "cell_type", "marker", "required"), rules.select("marker").join(known, "marker", "left_anti").distinct().orderBy("marker")


def rules_matrix(rules: DataFrame) -> DataFrame:
    """Marker rows and a column a type, with +, - and blanks; the types are a form's columns."""
    types = [r.cell_type for r in rules.groupBy("cell_type").agg(F.min("type_ord").alias("o")).orderBy("o").collect()]
    sign = F.when(F.col("required") == 1, "+").when(F.col("required") == 2, "-").otherwise("")
    return rules.groupBy(F.col("marker").alias("Marker")).pivot("cell_type", types).agg(F.first(sign)).fillna("")


def write_rules(rules: DataFrame, path: str) -> None:
    rules_matrix(rules).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")  # a form's size


def write_cells(cells: DataFrame, path: str, by: str | None = None) -> None:
    """The cell table as Parquet, in folders by image where such a column is named."""
    writer = cells.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_cell_bundle(cells: DataFrame, cell_marker: DataFrame, folder: str, states: DataFrame | None = None, thresholds: DataFrame | None = None, region: str | None = None) -> None:
    """A folder a slot: obs, X (long means), layers/intensity, layers/positive, obsm/spatial, uns/thresholds, uns/export.

    `positive` is written only if every marker has states; `spatial` is in microns where the table has them. uns/export has
    the time of the export (ISO 8601). With the name of the label element that the cells come from, obs has it as `region`,
    and uns/export names that column and the one of the cells' ids.
    """
    spatial = ("x_um", "y_um") if "x_um" in cells.columns else ("x_px", "y_px")
    obs = cells if region is None else cells.withColumn("region", F.lit(region))
    obs.write.mode("overwrite").parquet(f"{folder}/obs")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("export_date")
    link = [F.lit(x).cast("string").alias(c) for c, x in (("region", region), ("region_key", region and "region"), ("instance_key", region and "cell_id"))]
    cells.sparkSession.range(1).select(now, *link).coalesce(1).write.mode("overwrite").parquet(f"{folder}/uns/export")
    means = cell_marker.select("cell_id", "marker", F.col("mean").alias("value"))
    means.write.mode("overwrite").parquet(f"{folder}/X")
    means.write.mode("overwrite").parquet(f"{folder}/layers/intensity")
    cells.select("cell_id", F.array(*spatial).alias("spatial")).write.mode("overwrite").parquet(f"{folder}/obsm/spatial")
    if states is not None and cell_marker.select("marker").distinct().join(states.select("marker").distinct(), "marker", "left_anti").isEmpty():
        states.select("cell_id", "marker", (F.col("state") == 2).alias("value")).write.mode("overwrite").parquet(f"{folder}/layers/positive")
    if thresholds is not None:
        thresholds.write.mode("overwrite").parquet(f"{folder}/uns/thresholds")


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder a table, with a header."""
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def read_projects(spark: SparkSession, pattern: str) -> DataFrame:
    """Cell tables of many stores in one scan, with sample and method from each store's name."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(pattern).withColumn("_path", F.input_file_name())
    name = F.regexp_extract("_path", r"/([^/]+)_(AI|Otsu)(?:\.zarr)?/", 1)
    method = F.regexp_extract("_path", r"/([^/]+)_(AI|Otsu)(?:\.zarr)?/", 2)
    return rows.withColumns({"sample": name, "method": method}).where("method <> ''").drop("_path")
