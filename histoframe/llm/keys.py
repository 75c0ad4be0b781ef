"""Unique keys for the rows of a table whose ids may be null, repeated or any 64-bit number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoframe.scratch import Scratch


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_row_keys(docs: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The rows with a doc_id and a column `key` of unique longs in the order of doc_id; and whether an id is repeated.

    Unique ids are the keys themselves. Where ids are repeated, rows are numbered in the order of doc_id and a hash of
    text, by ranges, in a written table; so no id is too large, and neither many rows of one id nor equal rows meet in a
    task.
    """
    rows = docs.where("doc_id is not null")
    most = rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    if most == 1:
        return rows.withColumn(key, F.col("doc_id").cast("long")), False
    part, tie, base = (free_name(docs, x) for x in ("_part", "_tie", "_base"))
    order = [F.col("doc_id").cast("long"), F.xxhash64("text"), F.col(tie)]
    placed = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    placed = scratch.table(placed, "placed")
    offsets, total = [], 0
    for r in placed.groupBy(part).count().orderBy(part).collect():  # one row a partition
        offsets.append((r[part], total))
        total += r["count"]
    bases = docs.sparkSession.createDataFrame(offsets, f"`{part}` int, `{base}` long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    numbered = placed.join(F.broadcast(bases), part).withColumn(key, place + F.col(base))
    return scratch.table(numbered.select(*docs.columns, key), "numbered"), True
