"""Running statistics of cells as tile files arrive.

The state of a tile is its newest version, in parts, with one row a part, cell and marker. A micro-batch adds a written table of partial rows;
every few batches these and the state so far are merged into a new state. So the rows of a tile may come in any number of
files and batches, and what a reader sums up stays small.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from histoframe.scratch import exists, open_fs

#: A part, if it isn't null, is whole in one file; a part that is sent again replaces the one before.
SCHEMA = "image_id string, ty int, tx int, version long, part int, cell_id long, marker string, value double"
PARTIAL = "image_id string, ty int, tx int, version long, part int, sent struct<batch:bigint,file:string>, cell_id long, marker string, n long, sum double, max double"
TILE = ["image_id", "ty", "tx"]
SENT = ["version", "part", "sent"]


def tile_partials(readings: DataFrame, batch_id: int) -> DataFrame:
    """(image_id, ty, tx, version, part, sent, cell_id, marker, n, sum, max) of the readings of tiles in one batch.

    All background of a tile is one row of cell 0, so that a tile without cells leaves its version behind too. `sent` tells
    sendings of one part apart; readings without a part have none.
    """
    back = F.coalesce(F.col("cell_id") <= 0, F.lit(True))
    sent = F.when(F.col("part").isNotNull(), F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("_file").alias("file")))
    known = readings.withColumns({"cell_id": F.when(back, 0).otherwise(F.col("cell_id")), "marker": F.when(back, "").otherwise(F.col("marker")), "sent": sent})
    return known.groupBy(*TILE, *SENT, "cell_id", "marker").agg(F.count("value").alias("n"), F.sum("value").alias("sum"), F.max("value").alias("max"))


def _only_newest(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with the greatest value of a column for their keys, null for null."""
    newest = rows.groupBy(*keys).agg(F.max(column).alias("_newest"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys]
    return rows.alias("p").join(newest.alias("q"), [*same, F.col(f"p.{column}").eqNullSafe(F.col("q._newest"))], "left_semi")


def merged(partials: DataFrame) -> DataFrame:
    """Of each tile the rows of its newest version, of each part the last one sent; those of a part, cell and marker added up.

    Background keeps its row.
    """
    rows = _only_newest(_only_newest(partials, TILE, "version"), [*TILE, "version", "part"], "sent")
    return rows.groupBy(*TILE, *SENT, "cell_id", "marker").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("max").alias("max"))


def _written(target: str, kind: str) -> list[int]:
    """The batches whose table of a kind, `batch` or `state`, is whole."""
    file_system, path = open_fs(target)
    if file_system.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = [re.fullmatch(rf"{kind}-(\d+)", f.base_name) for f in file_system.get_file_info(fs.FileSelector(path))]
    return sorted(int(m[1]) for m in found if m and exists(f"{target}/{m[0]}/_SUCCESS"))


def state(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The last state and all batches since, merged; of batches up to `before`, where it is given."""
    states, batches = ([k for k in _written(target, kind) if before is None or k <= before] for kind in ("state", "batch"))
    base = states[-1] if states else -1
    paths = [f"{target}/state-{k}" for k in states[-1:]] + [f"{target}/batch-{k}" for k in batches if k > base]
    if not paths:
        return spark.createDataFrame([], PARTIAL)
    return merged(spark.read.schema(PARTIAL).parquet(*paths).select(*TILE, *SENT, "cell_id", "marker", "n", "sum", "max"))


def compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """Write the state up to a batch. What the state before it was made of goes; what this one is made of stays until the
    next, for readers that have begun."""
    if batch_id in _written(target, "state"):  # a batch that is tried again
        return
    state(spark, target, batch_id).write.mode("overwrite").parquet(f"{target}/state-{batch_id}")
    states = _written(target, "state")
    if len(states) > 1:
        old = [f"batch-{k}" for k in _written(target, "batch") if k <= states[-2]] + [f"state-{k}" for k in states[:-2]]
        for name in old:
            file_system, path = open_fs(f"{target}/{name}")
            file_system.delete_dir(path)


def cell_statistics(spark: SparkSession, target: str) -> DataFrame:
    """(image_id, cell_id, marker, n, sum, max, mean) over the newest version of every tile that has arrived."""
    rows = state(spark, target).where("cell_id > 0")
    out = rows.groupBy("image_id", "cell_id", "marker").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("max").alias("max"))
    return out.withColumn("mean", F.when(F.col("n") > 0, F.col("sum") / F.nullif("n", F.lit(0))).otherwise(0.0))


def incremental_cell_stats(stream: DataFrame, target: str, checkpoint: str, once: bool = False, compact_every: int = 16) -> StreamingQuery:
    """Keep the state of tiles in a folder of Parquet tables, from a stream of readings (SCHEMA; without `part` it is null).

    A micro-batch is written to its own table, batch-id, replacing what a failed attempt left, so each reading counts once.
    Readings of one tile and version add up, in however many files and batches they come; only a part that is sent again
    replaces what it was. A greater version of a tile replaces all its earlier readings; a smaller one that comes late
    changes nothing; one without cells leaves nothing. Every `compact_every` batches the tables are merged.
    """
    known = stream if "part" in stream.columns else stream.withColumn("part", F.lit(None).cast("int"))
    known = known.withColumn("_file", F.input_file_name())

    def put(batch: DataFrame, batch_id: int) -> None:
        tile_partials(batch, batch_id).write.mode("overwrite").parquet(f"{target}/batch-{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, target, batch_id)

    writer = known.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
