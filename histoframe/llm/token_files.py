"""Token-ID files: flat unsigned integers with 64-bit document offsets, written in shards and read memory-mapped.

A shard `part-NNNNN` is three files: `.ids` (all ids of its documents, end ids included, little-endian, 16 bits where the
vocabulary allows and 32 otherwise), `.offsets` (64-bit, one more than documents, from 0) and `.docs` (64-bit document
ids). Shards hold ascending ranges of doc_id. The base of a shard, the ids in all shards before it, is the prefix sum
over the shards' sizes, which are one row a shard.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoframe.llm.chunks import binary_column, bytes_of
from histoframe.llm.encoder import encoder
from histoframe.scratch import Scratch, open_fs, write_file

SHARD_SCHEMA = "shard int, n_docs long, n_ids long, width int"
DOC_SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"
END_ID = 0
ROWS = 1_000  # in an Arrow batch


def encoded(docs: DataFrame, tokenizer_path: str, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """(shard, doc_id, ids): the ids of each text with its end id, as the file format holds them, and the shard's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at, ids, counts in enc.encode_column(batch.column(1), end_id):
                own = batch.column(0).slice(at, len(counts))
                shard = np.searchsorted(bounds, own.to_numpy(), "left").astype(np.int32)
                starts = np.concatenate([[0], np.cumsum(counts)]) * enc.dtype.itemsize
                for lo in range(0, len(counts), ROWS):
                    some = starts[lo : lo + ROWS + 1]
                    rows = binary_column(ids.view(np.uint8)[some[0] : some[-1]], some - some[0])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[lo : lo + ROWS]), own.slice(lo, ROWS), rows], ["shard", "doc_id", "ids"])

    return docs.mapInArrow(run, "shard int, doc_id long, ids binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, shards: int, end_id: int = END_ID) -> list:
    """Write (doc_id, text) as token files in ascending doc_id order; returns the manifest, one row a shard that has rows.

    Null texts are empty (the end id alone). Documents without an id are left out, as the format has no place for them.
    Rows with the same doc_id all stay, ordered by their ids. A retried task writes the same files again. Texts are encoded
    where they are scanned; ids travel to their shard, whose range is set by the quantiles of doc_id.
    """
    width = encoder(tokenizer_path).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = first.column(0)[0].as_py()

        def ids(out) -> None:
            for batch in itertools.chain([first], batches):
                if batch.num_rows and not (batch.column(0).to_numpy() == shard).all():
                    raise ValueError("a task writes one shard")
                raw, starts = bytes_of(batch.column(2))
                doc_ids.append(batch.column(1).to_numpy().astype("<i8"))
                sizes.append(np.diff(starts) // width)
                out.write(memoryview(raw))

        stem = f"{folder}/part-{shard:05d}"
        write_file(f"{stem}.ids", ids)
        lengths = np.concatenate([np.zeros(1, "<i8"), *sizes])
        write_file(f"{stem}.offsets", lambda out: out.write(np.cumsum(lengths).astype("<i8").tobytes()))
        write_file(f"{stem}.docs", lambda out: out.write(b"".join(x.tobytes() for x in doc_ids)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(lengths) - 1], "n_ids": [int(lengths.sum())], "width": pa.array([width], pa.int32())})

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    parts = [k / shards for k in range(1, shards)]
    found = numbered.agg(F.percentile_approx("doc_id", parts, 20 * shards).alias("q")).first().q if parts else None
    bounds = sorted(set(found or []))  # one number a shard; at most these reach the driver
    ordered = encoded(numbered, tokenizer_path, bounds, end_id).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(write, SHARD_SCHEMA).collect()


def shard_bases(spark: SparkSession, manifest: list) -> DataFrame:
    """The manifest with each shard's base: a prefix sum over one row a shard."""
    bases, total = [], 0
    for row in sorted(manifest, key=lambda r: r.shard):
        bases.append((row.shard, row.n_docs, row.n_ids, row.width, total))
        total += row.n_ids
    return spark.createDataFrame(bases, SHARD_SCHEMA + ", base long")


def mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is mounted, else read through it."""
    file_system, path = open_fs(uri)
    if not file_system.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(file_system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with file_system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, manifest: list, rows: int = 2_000) -> DataFrame:
    """One row a document, from the files: its id, shard, start over all shards, size and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                stem = f"{folder}/part-{shard['shard']:05d}"
                offsets, docs = mapped(f"{stem}.offsets", np.dtype("<i8")), mapped(f"{stem}.docs", np.dtype("<i8"))
                ids = mapped(f"{stem}.ids", np.dtype(f"<u{shard['width']}"))
                for lo in range(0, len(docs), rows):
                    some = docs[lo : lo + rows]
                    cuts = np.asarray(offsets[lo : lo + len(some) + 1])
                    words = ids[cuts[0] : cuts[-1]].astype("<u4")
                    inner = cuts - cuts[0]
                    crcs = [zlib.crc32(words[a:b].tobytes()) for a, b in zip(inner[:-1], inner[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(np.asarray(some), pa.int64()),
                            "shard": pa.array(np.full(len(some), shard["shard"], np.int32)),
                            "start": pa.array(cuts[:-1] + shard["base"]),
                            "n_tokens": pa.array(np.diff(cuts)),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    shards = shard_bases(spark, manifest)
    return shards.repartition(max(1, len(manifest)), "shard").mapInArrow(read, DOC_SCHEMA)


def token_files(docs: DataFrame, tokenizer_path: str, shards: int | None = None) -> DataFrame:
    """Write the token files of `docs` into the shared folder and read them back."""
    spark = docs.sparkSession
    folder = Scratch(spark, "token-files").folder("shards")
    manifest = write_token_files(docs, folder, tokenizer_path, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_token_files(spark, folder, manifest)
