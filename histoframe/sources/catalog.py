"""Images, channels and panels of a store, from its metadata files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histoframe.functions.columns import natural_key

META = "map<string,string>"


def _first_last(df: DataFrame) -> DataFrame:
    """`stitched` first, then names in natural order; adds ord."""
    w = Window.orderBy(F.when(F.lower("name") == "stitched", 0).otherwise(1), natural_key(F.col("name")), "name")  # a store's images
    return df.withColumn("ord", F.row_number().over(w) - 1)


def read_catalog(spark: SparkSession, store: str) -> DataFrame:
    """(image_id, name, attributes, ord): images of a store; an error if there is none.

    They are the image groups of the consolidated metadata; where that lists none, those whose folder has a metadata file.
    """
    for rows in (read_arrays(spark, store), _listed(spark, store)):
        groups = rows.where(F.col("path").rlike("^images/[^/]+$") & (F.coalesce(F.get_json_object("meta", "$.node_type"), F.lit("group")) == "group"))
        images = groups.select(F.regexp_extract("path", "^images/(.+)$", 1).alias("name"), F.get_json_object("meta", "$.attributes").alias("attributes"))
        found = _first_last(images).select(F.col("name").alias("image_id"), "name", "attributes", "ord")
        if not found.isEmpty():
            return found
    raise ValueError(f"no image in {store}")


def _metadata_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, meta) of the metadata files that a pattern finds, the path from the folder `images` on; maybe no row."""
    try:
        text = spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, meta string")
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(F.regexp_extract(name, r"(images/[^/]+(?:/\d+)?|)/?zarr\.json$", 1).alias("path"), F.col("value").alias("meta"))


def _listed(spark: SparkSession, store: str) -> DataFrame:
    """(path, meta) of the images and their first levels, from the files of their folders."""
    return _metadata_files(spark, f"{store}/images/*/zarr.json").unionByName(_metadata_files(spark, f"{store}/images/*/0/zarr.json"))


def read_arrays(spark: SparkSession, store: str) -> DataFrame:
    """(path, meta): every entry of the consolidated metadata; none without a root file."""
    entries = F.from_json(F.get_json_object("meta", "$.consolidated_metadata.metadata"), META)
    return _metadata_files(spark, f"{store}/zarr.json").select(F.explode(entries).alias("path", "meta"))


def _path(attributes: str, *names: str):
    return F.coalesce(*(F.get_json_object(attributes, f"$.{n}") for n in names))


def read_channels(spark: SparkSession, store: str) -> DataFrame:
    """(image_id, channel_idx, name): the labels of an image; `Channel 0`, `Channel 1` and on are appended up to its channel
    count, always from 0, and labels beyond the count are cut."""
    images = read_catalog(spark, store)
    both = read_arrays(spark, store).unionByName(_listed(spark, store)).dropDuplicates(["path"])
    arrays = both.select(F.regexp_extract("path", "^images/([^/]+)/0$", 1).alias("image_id"), F.from_json(F.get_json_object("meta", "$.shape"), "array<int>").alias("shape")).where("image_id <> ''")
    labels = F.from_json(_path("attributes", "ome.omero.channels", "omero.channels"), "array<struct<label:string>>")
    both = images.join(arrays, "image_id", "left").withColumn("labels", F.coalesce(F.transform(labels, lambda c: c["label"]), F.array().cast("array<string>")))
    n = F.coalesce(F.when(F.size("shape") == 3, F.col("shape")[0]), F.greatest(F.size("labels"), F.lit(1)))
    padding = F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.lit("Channel "), k.cast("string")))
    names = F.slice(F.concat("labels", padding), F.lit(1), n)
    return both.select("image_id", F.posexplode(names).alias("channel_idx", "name"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(metal, label) of an acquisition panel in XML; of a repeated metal the last line counts."""
    rows = spark.read.format("xml").option("rowTag", "AcquisitionChannel").load(path).select(F.trim("ChannelName").alias("metal"), F.trim("ChannelLabel").alias("label"))
    return rows.withColumn("_ord", F.monotonically_increasing_id()).where("metal is not null and metal <> ''").groupBy("metal").agg(F.max_by("label", "_ord").alias("label"))


def enrich_panel(channels: DataFrame, panel: DataFrame) -> DataFrame:
    """Names become `metal / protein`: the label without a leading mass and element; metals without a label stay."""
    useful = panel.where("label is not null and label <> '' and label <> metal")
    joined = channels.join(F.broadcast(useful.withColumnRenamed("metal", "name")), "name", "left")  # a panel has some forty lines
    protein = F.regexp_replace("label", "^[0-9]+[A-Za-z]+_?", "")
    protein = F.when(protein == "", F.col("label")).otherwise(protein)
    return joined.withColumn("name", F.when(F.col("label").isNotNull(), F.concat_ws(" / ", "name", protein)).otherwise(F.col("name"))).drop("label").select(*channels.columns)


def classify_layers(layers: DataFrame, target: str = "mask") -> DataFrame:
    """Kind and name of imported layers (ord, name): a `Cell:`, `Mask:` or `Type:` prefix decides and goes; else the target.

    Empty names become `Imported Mask i` or `Type i`, i from 1.
    """
    trimmed = F.trim(F.coalesce("name", F.lit("")))
    kind = F.when(trimmed.startswith("Cell:"), "cell_mask").when(trimmed.startswith("Mask:"), "mask").when(trimmed.startswith("Type:"), "type_mask").otherwise(F.lit(target))
    rest = F.trim(F.regexp_replace(trimmed, "^(Cell|Mask|Type):", ""))
    number = (F.col("ord") + 1).cast("string")
    fallback = F.when(kind == "type_mask", F.concat(F.lit("Type "), number)).otherwise(F.concat(F.lit("Imported Mask "), number))
    return layers.select("ord", kind.alias("kind"), F.when(rest == "", fallback).otherwise(rest).alias("name"))


def levels(arrays: DataFrame) -> DataFrame:
    """(image_id, level, downsample) from (image_id, level, width): the base width over the level's."""
    base = arrays.groupBy("image_id").agg(F.max_by("width", -F.col("level")).alias("_w"))
    return arrays.join(F.broadcast(base), "image_id").select("image_id", "level", (F.col("_w") / F.col("width")).alias("downsample"))  # one row an image


def select_level(levels_: DataFrame, spp: float) -> DataFrame:
    """(image_id, level): the coarsest level with 1 / downsample >= 0.75 spp before the first that fails; 0 when spp >= 1."""
    if spp >= 1:
        return levels_.select("image_id", F.lit(0).alias("level")).distinct()
    fails = F.min(F.when(1 / F.col("downsample") < 0.75 * spp, F.col("level")))
    return levels_.groupBy("image_id").agg(F.greatest(F.coalesce(fails - 1, F.max("level")), F.lit(0)).alias("level"))


def parse_projects(paths: DataFrame) -> DataFrame:
    """(path, sample, method) of stores named `<sample>_AI` or `<sample>_Otsu`; other names go."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.zarr)?/*$", 1)
    return paths.select("path", F.regexp_extract(name, "^(.*)_(AI|Otsu)$", 1).alias("sample"), F.regexp_extract(name, "^(.*)_(AI|Otsu)$", 2).alias("method")).where("method <> ''")


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, kind) of the layers that a session file lists."""
    text = spark.read.text(path, wholetext=True)
    channels = F.from_json(F.get_json_object("value", "$.channels"), "array<struct<name:string,kind:string>>")
    return text.select(F.posexplode(channels).alias("ord", "c")).select("ord", "c.name", "c.kind")


def read_session_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row: pixel_size, cluster_names (a map from cluster_id), and rules, as a session file has them; null where it doesn't."""
    rule = "struct<type_ord:int,cell_type:string,marker:string,required:int>"
    state = F.from_json("value", f"pixel_size double, clustering struct<names:map<string,string>>, phenotyping struct<rules:array<{rule}>>").alias("s")
    names = F.transform_keys("s.clustering.names", lambda k, _: k.cast("int")).alias("cluster_names")
    return spark.read.text(path, wholetext=True).select(state).select("s.pixel_size", names, F.col("s.phenotyping.rules").alias("rules"))


def write_session(layers: DataFrame, path: str, pixel_size: float | None = None, cluster_names: DataFrame | None = None, rules: DataFrame | None = None) -> None:
    """One JSON file with the layers in order, from (ord, name, kind); with the size of a pixel in microns, the names of
    clusters (cluster_id, name) and the rules (type_ord, cell_type, marker, required), where they are given."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name", "kind")))
    sections = [layers.agg(F.to_json(F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind")))).alias("json")).withColumn("section", F.lit("channels"))]
    if pixel_size is not None:
        sections.append(layers.agg(F.to_json(F.array(F.lit(float(pixel_size)))).alias("json")).select(F.regexp_extract("json", r"^\[(.*)\]$", 1).alias("json"), F.lit("pixel_size").alias("section")))
    if cluster_names is not None:
        entries = F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("string"), "name")))
        sections.append(cluster_names.agg(F.to_json(F.struct(F.map_from_entries(entries).alias("names"))).alias("json")).withColumn("section", F.lit("clustering")))
    if rules is not None:
        listed = F.array_sort(F.collect_list(F.struct("type_ord", "cell_type", "marker", "required")))
        sections.append(rules.agg(F.to_json(F.struct(listed.alias("rules"))).alias("json")).withColumn("section", F.lit("phenotyping")))
    whole = reduce(DataFrame.unionByName, sections)  # one row a section
    fields = F.array_sort(F.collect_list(F.concat(F.lit('"'), "section", F.lit('":'), "json")))
    whole.agg(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("value")).write.mode("overwrite").text(path)
