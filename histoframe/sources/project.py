"""A project store: which label maps, images, auxiliary arrays and shapes it has, and their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoframe.sources.catalog import read_arrays
from histoframe.sources.zarr_tiles import read_tiles

SCHEMA_VERSION = 1


def read_project(spark: SparkSession, store: str) -> DataFrame:
    """(section, key, path, shape, original_shape): the arrays of a project by section (labels, images, extra_aux).

    The key is the one in the element's attributes, else its folder's name. Auxiliary arrays keep their stored original
    shape for readers to restore. A project of a newer schema than this package knows is an error.
    """
    entries = read_arrays(spark, store)
    version = F.get_json_object("value", "$.attributes.schema_version")
    newer = spark.read.text(f"{store}/zarr.json", wholetext=True).where(version.cast("int") > SCHEMA_VERSION)
    if not newer.isEmpty():
        raise ValueError(f"{store} has a newer schema than {SCHEMA_VERSION}")
    part = r"^(labels|images|[a-z_]*aux)/([^/]+)"
    arrays = entries.where(F.get_json_object("meta", "$.shape").isNotNull() & F.col("path").rlike(part + r"(/0)?$"))
    groups = entries.where(F.col("path").rlike(part + "$")).select(F.col("path").alias("group"), F.get_json_object("meta", "$.attributes.key").alias("own"))
    found = arrays.withColumn("group", F.regexp_replace("path", "/0$", "")).join(groups, "group", "left")
    shape = F.from_json(F.get_json_object("meta", "$.shape"), "array<int>")
    original = F.from_json(F.get_json_object("meta", "$.attributes.original_shape"), "array<int>")
    section, name = F.regexp_extract("path", part, 1), F.regexp_extract("path", part, 2)
    return found.select(section.alias("section"), F.coalesce("own", name).alias("key"), "path", shape.alias("shape"), F.coalesce(original, shape).alias("original_shape"))


def project_tiles(spark: SparkSession, store: str, path: str) -> DataFrame:
    """The tiles of one array of a project."""
    return read_tiles(spark, store, path)
