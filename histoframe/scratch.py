"""Tables and files that a job writes for itself in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from histoframe.session import ship_package

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local runs, tests)."""
    ship_package(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-histoframe-")
    return _own[app]


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; usable on the driver and in tasks."""
    return fs.FileSystem.from_uri(uri)


class Scratch:
    """A folder of written tables: writing cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            file_system, path = open_fs(self.path(name))
            if file_system.get_file_info(path).type != fs.FileType.NotFound:
                file_system.delete_dir(path)

    def folder(self, name: str) -> str:
        """An empty folder for files that tasks write, as a URI."""
        file_system, path = open_fs(self.path(name))
        file_system.create_dir(path, recursive=True)
        return self.path(name)


def write_file(uri: str, write: Callable[[object], None]) -> None:
    """Write a file by a temporary name and move it into place, so a retried task replaces it whole."""
    file_system, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with file_system.open_output_stream(part) as out:
        write(out)
    file_system.move(part, path)


def exists(uri: str) -> bool:
    file_system, path = open_fs(uri)
    return file_system.get_file_info(path).type != fs.FileType.NotFound
