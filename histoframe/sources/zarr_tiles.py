"""Zarr v3 arrays as a Spark data source of tiles, one row a stored chunk, and a writer of tiles as chunks.

    read_tiles(spark, store, "images/s001/0")

Rows: image_id, level, channel_idx, ty, tx, y0, x0, h, w, dtype, pixels (little-endian, clipped to the array). Reading is
split by chunks; where the session has `spark.sql.python.filterPushdown.enabled`, filters on channel_idx, ty, tx, y0 and x0
choose chunks before any is opened, and Spark applies them after reading elsewhere. A chunk that isn't stored is the fill
value. Chunks of two axes (y, x) have channel 0. NaN and infinite values become 0.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition, LessThan

from histoframe.scratch import exists, open_fs, write_file

SCHEMA = "image_id string, level int, channel_idx int, ty int, tx int, y0 int, x0 int, h int, w int, dtype string, pixels binary"
CHUNKS_A_TASK = 16
MOST_TASKS = 50_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Array:
    """What an array's zarr.json says."""

    def __init__(self, meta: dict):
        self.shape = meta["shape"]
        self.chunk = meta["chunk_grid"]["configuration"]["chunk_shape"]
        self.dtype = np.dtype(meta["data_type"])
        self.fill = 0 if meta.get("fill_value") in (None, "NaN", "Infinity", "-Infinity") else meta["fill_value"]
        encoding = meta.get("chunk_key_encoding", {"name": "default"})
        self.prefix = "c" if encoding.get("name", "default") == "default" else ""
        self.separator = encoding.get("configuration", {}).get("separator", "/" if self.prefix else ".")
        self.zstd, self.order = False, "<"
        for codec in meta.get("codecs", []):
            if codec["name"] == "bytes":
                self.order = ">" if codec.get("configuration", {}).get("endian") == "big" else "<"
            elif codec["name"] == "zstd":
                self.zstd = True
            else:
                raise ValueError(f"codec {codec['name']} is not supported")

    def grid(self) -> list[int]:
        return [math.ceil(s / c) for s, c in zip(self.shape, self.chunk, strict=True)]

    def key(self, at: tuple[int, ...]) -> str:
        return self.separator.join([*([self.prefix] if self.prefix else []), *map(str, at)])

    def decode(self, raw: bytes | None, at: tuple[int, ...]) -> np.ndarray:
        """The chunk clipped to the array, as (channels, rows, columns)."""
        clip = [min(c, s - c * k) for c, s, k in zip(self.chunk, self.shape, at, strict=True)]
        if raw is None:
            found = np.full(clip, self.fill, self.dtype)
        else:
            if self.zstd:
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            values = np.frombuffer(raw, self.dtype.newbyteorder(self.order))
            if values.size == math.prod(self.chunk):
                found = values.reshape(self.chunk)[tuple(slice(0, n) for n in clip)]
            elif values.size == math.prod(clip):
                found = values.reshape(clip)
            else:
                raise ValueError(f"chunk {at} has {values.size} values")
        if found.dtype.kind == "f":
            found = np.nan_to_num(found, nan=0.0, posinf=0.0, neginf=0.0)
        return found.astype(self.dtype.newbyteorder("<")).reshape((-1, *found.shape[-2:]))


def _read(uri: str) -> bytes | None:
    file_system, path = open_fs(uri)
    if file_system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with file_system.open_input_file(path) as f:
        return f.read()


class _Chunks(InputPartition):
    """A range of the chunks that are asked for, in the order of their places; tasks work the places out."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class ZarrReader(DataSourceReader):
    def __init__(self, store: str, array: str):
        self.root = f"{store.rstrip('/')}/{array}"
        raw = _read(f"{self.root}/zarr.json")
        if raw is None:
            raise FileNotFoundError(f"{self.root}/zarr.json")
        self.array = Array(json.loads(raw))
        found = re.search(r"([^/]+)/(\d+)$", array)
        self.image_id, self.level = (found[1], int(found[2])) if found else (array.rsplit("/", 1)[-1], 0)
        self.want: dict[str, set[int]] = {}
        self.span: list[tuple[int, int, int, bool]] = []

    def _asked(self, name: str, value: int) -> bool:
        return name not in self.want or value in self.want[name]

    def _axes(self) -> list[list[int]]:
        """The chunk numbers that are asked for on each axis of the array."""
        a = self.array
        axes = [list(range(n)) for n in a.grid()]
        if len(axes) == 3 and "channel_idx" in self.want:
            groups = {c // a.chunk[0] for c in self.want["channel_idx"]}
            axes[0] = [c for c in axes[0] if c in groups]
        axes[-2] = [y for y in axes[-2] if self._asked("ty", y)]
        axes[-1] = [x for x in axes[-1] if self._asked("tx", x)]
        for axis, edge, limit, above in self.span:
            axes[axis] = [k for k in axes[axis] if (k * edge > limit if above else k * edge < limit)]
        return axes

    def partitions(self) -> list[InputPartition]:
        n = math.prod(map(len, self._axes()))
        step = max(CHUNKS_A_TASK, math.ceil(n / MOST_TASKS))
        return [_Chunks(k, min(n, k + step)) for k in range(0, n, step)] or [_Chunks(0, 0)]  # Spark asks for one at least

    def read(self, partition: _Chunks) -> Iterator[tuple]:
        a, axes = self.array, self._axes()
        for number in range(partition.start, partition.stop):
            at: tuple[int, ...] = ()
            for asked in reversed(axes):
                number, k = divmod(number, len(asked))
                at = (asked[k], *at)
            block = a.decode(_read(f"{self.root}/{a.key(at)}"), at)
            ty, tx = at[-2:]
            first = at[0] * a.chunk[0] if len(at) == 3 else 0
            for k, plane in enumerate(block):
                if self._asked("channel_idx", first + k):
                    yield (self.image_id, self.level, first + k, ty, tx, ty * a.chunk[-2], tx * a.chunk[-1], plane.shape[0], plane.shape[1], a.dtype.name, plane.tobytes())


class PruningReader(ZarrReader):
    """Takes the filters that choose chunks."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] in ("channel_idx", "ty", "tx"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.want[f.attribute[0]] = self.want.get(f.attribute[0], values) & values
            else:
                if isinstance(f, GreaterThan | LessThan) and f.attribute[0] in ("y0", "x0"):
                    axis = -2 if f.attribute[0] == "y0" else -1
                    self.span.append((axis, self.array.chunk[axis], f.value, isinstance(f, GreaterThan)))
                yield f


class ZarrTiles(DataSource):
    """The data source `zarr_tiles`; option `array` names the array inside the store.

    Option `pushdown` true takes filters, which Spark refuses in a session where PUSHDOWN is off.
    """

    @classmethod
    def name(cls) -> str:
        return "zarr_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZarrReader:
        reader = PruningReader if self.options.get("pushdown", "false") == "true" else ZarrReader
        return reader(self.options["path"], self.options["array"])


def read_tiles(spark: SparkSession, store: str, array: str) -> DataFrame:
    """The tiles of an array, with filters pushed into the scan where the session allows it."""
    spark.dataSource.register(ZarrTiles)
    return spark.read.format("zarr_tiles").option("array", array).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(store)


def read_window(tiles: DataFrame, channel: int, y0: int, y1: int, x0: int, x1: int, edge: int = 0) -> DataFrame:
    """Tiles of a channel that a rectangle overlaps, cut to it; with the edge of the tiles, only their chunks are read."""
    if edge:
        tiles = tiles.where((F.col("y0") > y0 - edge) & (F.col("y0") < y1) & (F.col("x0") > x0 - edge) & (F.col("x0") < x1))
    inside = (F.col("channel_idx") == channel) & (F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0) & (F.col("x0") < x1) & (F.col("x0") + F.col("w") > x0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                plane = np.frombuffer(r["pixels"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"])
                a, b = max(0, y0 - r["y0"]), max(0, x0 - r["x0"])
                plane = plane[a : max(a, y1 - r["y0"]), b : max(b, x1 - r["x0"])]
                r |= {"y0": r["y0"] + a, "x0": r["x0"] + b, "h": plane.shape[0], "w": plane.shape[1], "pixels": plane.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return tiles.where(inside).mapInArrow(cut, tiles.schema)


def _write_json(folder: str, meta: dict) -> None:
    file_system, path = open_fs(folder)
    file_system.create_dir(path, recursive=True)
    write_file(f"{folder}/zarr.json", lambda out: out.write(json.dumps(meta).encode()))


def image_group(name: str, levels: list[tuple[str, list[int]]], channels: list[str]) -> dict:
    """Metadata of an image element: named axes, channel labels, and each level (path, shape) with its scale to the first."""
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "pixel"}, {"name": "x", "type": "space", "unit": "pixel"}]
    base = levels[0][1]
    datasets = [{"path": path, "coordinateTransformations": [{"type": "scale", "scale": [1.0, *(b / max(n, 1) for b, n in zip(base[1:], shape[1:], strict=True))]}]} for path, shape in levels]
    ome = {"version": "0.5", "multiscales": [{"name": name, "axes": axes, "datasets": datasets}], "omero": {"channels": [{"label": c} for c in channels]}}
    return {"zarr_format": 3, "node_type": "group", "attributes": {"key": name, "ome": ome}}


def _read_json(folder: str) -> dict | None:
    if not exists(f"{folder}/zarr.json"):
        return None
    file_system, path = open_fs(f"{folder}/zarr.json")
    with file_system.open_input_stream(path) as f:
        return json.loads(f.read())


def _write_group(element: str, name: str, channels: list[str] | None) -> None:
    """The element's metadata over all levels that are written; without channels their labels stay, or are their numbers."""
    file_system, path = open_fs(element)
    numbers = sorted(int(f.base_name) for f in file_system.get_file_info(fs.FileSelector(path)) if f.base_name.isdigit())
    levels = [(str(n), meta["shape"]) for n in numbers if (meta := _read_json(f"{element}/{n}"))]
    before = _read_json(element) or {}
    known = [c["label"] for c in before.get("attributes", {}).get("ome", {}).get("omero", {}).get("channels", [])]
    n = levels[0][1][0]
    _write_json(element, image_group(name, levels, channels or (known if len(known) == n else [str(k) for k in range(n)])))


def write_zarr_tiles(tiles: DataFrame, store: str, array: str, shape: tuple[int, int, int], edge: int, dtype: str, channels: list[str] | None = None) -> None:
    """Tiles (channel_idx, ty, tx, h, w, pixels) of `edge` pixels as zstd chunks, padded with zeros; the metadata last.

    Chunk files are written by the tasks that hold the tiles and moved into place whole, so a retried task is harmless.
    An array `<section>/<name>/<level>` gets its element's metadata too, with all levels written so far and the channels' names.
    """
    root = f"{store.rstrip('/')}/{array}"

    def put(rows) -> None:
        import zstandard

        for r in rows:
            plane = np.zeros((edge, edge), np.dtype(dtype).newbyteorder("<"))
            plane[: r.h, : r.w] = np.frombuffer(r.pixels, np.dtype(r.dtype).newbyteorder("<")).reshape(r.h, r.w)
            uri = f"{root}/c/{r.channel_idx}/{r.ty}/{r.tx}"
            file_system, path = open_fs(uri)
            file_system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            raw = zstandard.ZstdCompressor().compress(plane.tobytes())
            write_file(uri, lambda out, x=raw: out.write(x))

    tiles.select("channel_idx", "ty", "tx", "h", "w", "dtype", "pixels").foreachPartition(put)
    meta = {
        "zarr_format": 3,
        "node_type": "array",
        "shape": list(shape),
        "data_type": dtype,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, edge, edge]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0,
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 0, "checksum": False}}],
        "attributes": {},
        "dimension_names": ["c", "y", "x"],
    }
    _write_json(root, meta)
    if found := re.search(r"^(.*/([^/]+))/(\d+)$", root):
        _write_group(found[1], found[2], channels)
