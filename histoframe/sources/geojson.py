"""Regions and objects as GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histoframe.functions.columns import bounding_box, closed_ring, open_ring

_RINGS = "array<array<array<double>>>"
_POLYGONS = "array<array<array<array<double>>>>"


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson_regions(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, name, ring, bbox) from a FeatureCollection, a list of features or a single one.

    Outer rings of three points or more, repeated end points left off. Names are trimmed, `Region n` (n from 1, by feature)
    where empty; a feature with several valid parts numbers them ` 1`, ` 2` and on.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = F.trim("value")
    many = F.coalesce(F.get_json_object(doc, "$.features"), F.when(doc.startswith("["), doc), F.concat(F.lit("["), doc, F.lit("]")))
    features = text.select("file", F.posexplode(F.from_json(many, "array<string>")).alias("feature", "body"))
    kind = F.get_json_object("body", "$.geometry.type")
    points = F.get_json_object("body", "$.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(points, _RINGS))).when(kind == "MultiPolygon", F.from_json(points, _POLYGONS))
    name = F.trim(F.coalesce(F.get_json_object("body", "$.properties.name"), F.lit("")))
    named = F.when(name == "", F.concat(F.lit("Region "), (F.col("feature") + 1).cast("string"))).otherwise(name)
    parts = features.select("file", "feature", named.alias("name"), F.posexplode(polygons).alias("place", "polygon"))
    rings = parts.withColumn("ring", open_ring(_ring(F.get("polygon", F.lit(0))))).where(F.size("ring") >= 3)
    by_feature = Window.partitionBy("file", "feature")
    part = F.row_number().over(by_feature.orderBy("place"))
    several = F.count("*").over(by_feature) > 1
    out = rings.withColumns({"part": part, "_several": several})
    label = F.when(F.col("_several"), F.concat_ws(" ", "name", F.col("part").cast("string"))).otherwise(F.col("name"))
    return out.select("feature", "part", label.alias("name"), "ring", bounding_box(F.col("ring")).alias("bbox"))


def features_json(objects: DataFrame, kind: str = "annotation") -> DataFrame:
    """(id, value): one GeoJSON feature an object, from (id, name, part, ring); rings are closed, short ones dropped.

    One ring gives a Polygon, several a MultiPolygon; objectType is the kind, `annotation` or `detection`.
    """
    opened = objects.withColumn("ring", open_ring(F.col("ring"))).where(F.size(F.array_distinct("ring")) >= 3)
    pairs = F.transform(closed_ring(F.col("ring")), lambda p: F.array(p["x"], p["y"]))
    grouped = opened.groupBy("id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", pairs.alias("r")))), lambda s: s["r"]).alias("rings"))
    geometry = F.when(F.size("rings") == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json("rings"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(F.transform("rings", lambda r: F.array(r))), F.lit("}"))
    )
    properties = F.to_json(F.struct(F.lit(kind).alias("objectType"), F.col("name").alias("name")))
    return grouped.select("id", F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_geojson(objects: DataFrame, path: str, kind: str = "annotation") -> None:
    """One feature a line, in part files; each line is a GeoJSON document."""
    features_json(objects, kind).select("value").write.mode("overwrite").text(path)
