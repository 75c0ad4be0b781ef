"""Image tiles: filters with exact halos, intensity scaling, composites and retiling.

tiles: (image_id, level, channel_idx, ty, tx, y0, x0, h, w, dtype, pixels), tile (ty, tx) at (ty * edge, tx * edge). A
filter of radius r sees its tile and r pixels around it: each tile sends every neighbour the strip that it needs, and a
group a tile puts them together. Image edges are mirrored. Results don't depend on the tile size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.operators.planes import PLANE, each_row, plane_of
from histoframe.operators.ranks import tile_percentiles, tile_range
from histoframe.scratch import Scratch

KEYS = ("image_id", "level", "channel_idx", "ty", "tx")
Kernel = Callable[[np.ndarray], np.ndarray]


def map_tiles(tiles: DataFrame, f: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Each tile by itself; the result's dtype is the tile's new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                out = np.ascontiguousarray(f(plane_of(r), r))
                r |= {"dtype": out.dtype.name, "pixels": out.astype(out.dtype.newbyteorder("<")).tobytes()}
                yield pa.RecordBatch.from_pylist([r], batch.schema)

    return tiles.mapInArrow(run, tiles.schema)


def with_halo(tiles: DataFrame, radius: int, edge: int, kernel: Kernel, dtype: str = "float32") -> DataFrame:
    """The kernel over each tile with `radius` pixels around; it returns an array of the shape that it is given."""
    reach = -(-radius // edge)
    cut_schema = "image_id string, level int, channel_idx int, ty int, tx int, own boolean, py int, px int, ph int, pw int, dtype string, piece binary"
    names = [x.split()[0] for x in cut_schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                plane, out = plane_of(r), []
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        ty, tx = r["ty"] + dy, r["tx"] + dx
                        a, b = max(r["y0"], ty * edge - radius), min(r["y0"] + r["h"], (ty + 1) * edge + radius)
                        c, d = max(r["x0"], tx * edge - radius), min(r["x0"] + r["w"], (tx + 1) * edge + radius)
                        if a < b and c < d and ty >= 0 and tx >= 0:
                            piece = plane[a - r["y0"] : b - r["y0"], c - r["x0"] : d - r["x0"]]
                            out.append((r["image_id"], r["level"], r["channel_idx"], ty, tx, not dy and not dx, a, c, b - a, d - c, r["dtype"], piece.tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(n, k) for n, k in zip(names, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)]))

    def put(rows: pa.Table) -> pa.Table:
        pieces = rows.to_pylist()
        own = next((p for p in pieces if p["own"]), None)
        empty = pa.schema([("image_id", pa.string()), ("level", pa.int32()), ("channel_idx", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()), ("y0", pa.int32()), ("x0", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("pixels", pa.binary())])
        if own is None:  # no such tile
            return empty.empty_table()
        y0, x0 = min(p["py"] for p in pieces), min(p["px"] for p in pieces)
        y1, x1 = max(p["py"] + p["ph"] for p in pieces), max(p["px"] + p["pw"] for p in pieces)
        whole = np.zeros((y1 - y0, x1 - x0), np.dtype(own["dtype"]))
        for p in pieces:
            at = (slice(p["py"] - y0, p["py"] - y0 + p["ph"]), slice(p["px"] - x0, p["px"] - x0 + p["pw"]))
            whole[at] = np.frombuffer(p["piece"], np.dtype(p["dtype"]).newbyteorder("<")).reshape(p["ph"], p["pw"])
        ty0, tx0 = own["ty"] * edge, own["tx"] * edge
        h, w = min(edge, y1 - ty0), min(edge, x1 - tx0)
        pad = ((radius - (ty0 - y0), radius - (y1 - ty0 - h)), (radius - (tx0 - x0), radius - (x1 - tx0 - w)))
        seen = np.pad(whole, pad, mode="symmetric") if any(map(any, pad)) else whole
        out = kernel(seen)[radius : radius + h, radius : radius + w].astype(np.dtype(dtype).newbyteorder("<"))
        row = {k: own[k] for k in KEYS} | {"y0": ty0, "x0": tx0, "h": h, "w": w, "dtype": dtype, "pixels": np.ascontiguousarray(out).tobytes()}
        return pa.Table.from_pylist([row], empty)

    schema = ", ".join(f"{c} {k}" for c, k in (("image_id", "string"), ("level", "int"), ("channel_idx", "int"), ("ty", "int"), ("tx", "int"), ("y0", "int"), ("x0", "int"), ("h", "int"), ("w", "int"), ("dtype", "string"), ("pixels", "binary")))
    plain = tiles.select(*KEYS, "y0", "x0", "h", "w", "dtype", "pixels")
    return plain.mapInArrow(cut, cut_schema).groupBy(*KEYS).applyInArrow(put, schema)


# ---- kernels over whole arrays


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets within a radius, nearest first."""
    found = [(y * y + x * x, y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
    return [(y, x) for _, y, x in sorted(found)]


def _shifted(plane: np.ndarray, offsets: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    r = max(max(abs(y), abs(x)) for y, x in offsets)
    padded = np.pad(plane, r, mode="symmetric")
    for y, x in offsets:
        yield padded[r + y : r + y + plane.shape[0], r + x : r + x + plane.shape[1]]


def _fold(plane: np.ndarray, offsets: list[tuple[int, int]], f) -> np.ndarray:
    out = None
    for s in _shifted(plane, offsets):
        out = s.copy() if out is None else f(out, s)
    return out


def median_of(plane: np.ndarray, offsets: list[tuple[int, int]], rows: int = 64) -> np.ndarray:
    r = max(max(abs(y), abs(x)) for y, x in offsets)
    padded = np.pad(plane, r, mode="symmetric")
    out = np.empty(plane.shape, np.float64)
    for a in range(0, plane.shape[0], rows):
        b = min(a + rows, plane.shape[0])
        stack = np.stack([padded[r + y + a : r + y + b, r + x : r + x + plane.shape[1]] for y, x in offsets])
        out[a:b] = np.median(stack, axis=0)
    return out


def gaussian_of(plane: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = plane.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        n = out.shape[axis]
        out = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(weights))
    return out


def rolling_ball_of(plane: np.ndarray, radius: int) -> np.ndarray:
    """The surface that a ball of the radius reaches from below."""
    offsets = disk(radius)
    out = None
    for (y, x), s in zip(offsets, _shifted(plane.astype(np.float64), offsets), strict=True):
        lifted = s + (radius - np.sqrt(radius * radius - y * y - x * x))
        out = lifted if out is None else np.minimum(out, lifted)
    return out


# ---- filters


def median(tiles: DataFrame, edge: int, size: int = 3) -> DataFrame:
    r = max(1, size // 2)
    return with_halo(tiles, r, edge, lambda p: median_of(p, disk(r)))


def opening(tiles: DataFrame, edge: int, size: int = 3) -> DataFrame:
    """Grey opening: the least value, then the greatest, over a disk."""
    r = max(1, size // 2)
    return with_halo(tiles, 2 * r, edge, lambda p: _fold(_fold(p, disk(r), np.minimum), disk(r), np.maximum))


def gaussian(tiles: DataFrame, edge: int, sigma: float) -> DataFrame:
    return with_halo(tiles, int(4 * sigma + 0.5), edge, lambda p: gaussian_of(p, sigma))


def subtract_background(tiles: DataFrame, edge: int, sigma: float = 3, radius: int = 15) -> DataFrame:
    """The data less a rolling-ball background of the blurred data; never below 0."""
    reach = int(4 * sigma + 0.5) + 2 * radius
    return with_halo(tiles, reach, edge, lambda p: np.maximum(p - rolling_ball_of(gaussian_of(p, sigma), radius), 0))


def remove_hotpixels(tiles: DataFrame, edge: int, threshold: float = 10, passes: int = 3, size: int = 5) -> DataFrame:
    """Repeatedly: values further from the window's median than threshold * 1.48 * MAD become that median."""
    r = size // 2
    window = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]

    def kernel(p: np.ndarray) -> np.ndarray:
        out = p.astype(np.float64)
        for _ in range(passes):
            middle = median_of(out, window)
            spread = np.median(np.stack([np.abs(s - middle) for s in _shifted(out, window)]), axis=0)
            out = np.where(np.abs(out - middle) > threshold * 1.48 * spread, middle, out)
        return out

    return with_halo(tiles, 2 * r * passes, edge, kernel)


def edge_enhance(tiles: DataFrame, edge: int, sigma: float = 1.5) -> DataFrame:
    """The blurred image less its four-neighbour Laplacian."""

    def kernel(p: np.ndarray) -> np.ndarray:
        g = gaussian_of(p, sigma)
        up, down, left, right = _shifted(g, [(-1, 0), (1, 0), (0, -1), (0, 1)])
        return g - (up + down + left + right - 4 * g)

    return with_halo(tiles, int(4 * sigma + 0.5) + 1, edge, kernel)


def label_partials(tiles: DataFrame, label_tiles: DataFrame) -> DataFrame:
    """(image_id, cell_id, channel_idx, n, sum): pixels of each tile under each label, summed inside the task.

    The tiles of a place, label first, come one after the other in one exchange, so a label tile is sent once for all its
    channels. Both have the same grid; where their extents differ, both are cut to what they share, and places that one of
    them lacks have no rows. Label 0 is background; values that aren't finite count as 0.
    """
    place = ["image_id", "level", "ty", "tx"]
    columns = [*place, "channel_idx", "h", "w", "dtype", "pixels"]
    both = label_tiles.select(*place, F.lit(None).cast("int").alias("channel_idx"), *columns[5:]).unionByName(tiles.select(*columns))
    dealt = both.repartition(*place).sortWithinPartitions(*place, F.col("channel_idx").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, of = None, None, None
        for batch in batches:
            for r in each_row(batch):
                if r["channel_idx"] is None:
                    at = [r[c] for c in place]
                    names, of = np.unique(plane_of(r), return_inverse=True)
                    of = of.reshape(r["h"], r["w"])
                elif at == [r[c] for c in place]:
                    values = plane_of(r).astype(np.float64)
                    h, w = min(r["h"], of.shape[0]), min(r["w"], of.shape[1])
                    own, values = of[:h, :w].ravel(), np.nan_to_num(values[:h, :w].ravel(), nan=0.0, posinf=0.0, neginf=0.0)
                    n, sums = np.bincount(own, minlength=len(names)), np.bincount(own, values, minlength=len(names))
                    keep = (names > 0) & (n > 0)
                    k = int(keep.sum())
                    yield pa.RecordBatch.from_pydict({"image_id": pa.array([r["image_id"]] * k, pa.string()), "cell_id": pa.array(names[keep].astype(np.int64)), "channel_idx": pa.array(np.full(k, r["channel_idx"], np.int32)), "n": pa.array(n[keep].astype(np.int64)), "sum": pa.array(sums[keep])})

    return dealt.mapInArrow(run, "image_id string, cell_id long, channel_idx int, n long, sum double")


def cell_means_of_tiles(tiles: DataFrame, label_tiles: DataFrame) -> DataFrame:
    """(image_id, cell_id, channel_idx, n, sum, mean): cell means straight from image and label tiles."""
    out = label_partials(tiles, label_tiles).groupBy("image_id", "cell_id", "channel_idx").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    return out.withColumn("mean", F.col("sum") / F.col("n"))


def merge_channels(tiles: DataFrame, a: int, b: int, new: int) -> DataFrame:
    """A channel that is the mean of two, tile by tile."""
    left, right = tiles.where(F.col("channel_idx") == a), tiles.where(F.col("channel_idx") == b)
    other = right.select("image_id", "level", "ty", "tx", F.col("pixels").alias("_p"), F.col("dtype").alias("_d"))
    joined = left.join(other, ["image_id", "level", "ty", "tx"]).select(*left.columns, "_p", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                second = np.frombuffer(r.pop("_p"), np.dtype(r.pop("_d")).newbyteorder("<")).reshape(r["h"], r["w"])
                out = ((plane_of(r).astype(np.float32) + second.astype(np.float32)) / 2).astype("<f4")
                r |= {"channel_idx": new, "dtype": "float32", "pixels": out.tobytes()}
                yield pa.RecordBatch.from_pylist([r], pa.schema(list(batch.schema)[:-2]))

    return joined.mapInArrow(run, left.schema)


def pixel_values(tiles: DataFrame, step: int = 1) -> DataFrame:
    """(image_id, channel_idx, y, x, value) of every step-th row and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                y, x = np.mgrid[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
                keep = (y % step == 0) & (x % step == 0)
                n = int(keep.sum())
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([r["image_id"]] * n, pa.string()), "channel_idx": pa.array(np.full(n, r["channel_idx"], np.int32)), "y": pa.array(y[keep].astype(np.int32)), "x": pa.array(x[keep].astype(np.int32)), "value": pa.array(plane_of(r)[keep].astype(np.float64))})

    return tiles.mapInArrow(run, "image_id string, channel_idx int, y int, x int, value double")


def _scaled(tiles: DataFrame, low: float, high: float, f) -> DataFrame:
    """f(plane, low value, high value) with each channel's exact percentiles, which come along as columns."""
    ends = tile_percentiles(tiles, [low / 100, high / 100])
    return _with_ends(tiles, ends.select(*PLANE, F.col("p")[0].alias("_a"), F.col("p")[1].alias("_b")), f)


def _with_ends(tiles: DataFrame, ends: DataFrame, f) -> DataFrame:
    """ends: a written table of a row a channel, so Spark knows its size and broadcasts it only where it is small."""
    joined = tiles.join(ends, PLANE).select(*tiles.columns, "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                out = f(plane_of(r).astype(np.float64), r.pop("_a"), r.pop("_b")).astype("<f4")
                r |= {"dtype": "float32", "pixels": out.tobytes()}
                yield pa.RecordBatch.from_pylist([r], pa.schema(list(batch.schema)[:-2]))

    return joined.mapInArrow(run, tiles.schema)


def map_tiles_with_range(tiles: DataFrame, f) -> DataFrame:
    """f(plane, least, greatest) with the range of each channel's finite pixels, which is found by one row a tile."""
    found = Scratch(tiles.sparkSession, "tile-range").table(tile_range(tiles), "ends")
    return _with_ends(tiles, found.select(*PLANE, F.col("lo").alias("_a"), F.col("hi").alias("_b")), f)


def rescale(tiles: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """Values clipped to a percentile range and scaled to 0..1; to -1..1 where the low end is negative."""

    def f(p, a, b):
        share = np.clip((p - a) / (b - a), 0, 1) if b > a else np.zeros_like(p)
        return share if a >= 0 else 2 * share - 1

    return _scaled(tiles, low, high, f)


def normalize_input(tiles: DataFrame, low: float = 1, high: float = 99.8) -> DataFrame:
    """clip((v - low) / (high - low + 1e-6), 0, 1), for models."""
    return _scaled(tiles, low, high, lambda p, a, b: np.clip((p - a) / (b - a + 1e-6), 0, 1))


def clahe(tiles: DataFrame, edge: int, low: float = 1, high: float = 99.8, size: int = 20, clip: float = 0.05) -> DataFrame:
    """Contrast-limited adaptive equalisation: scaled to 0..1, equalised with the clipped histogram of the window of `size`
    pixels around each block of half that size, between blocks by linear interpolation, and scaled back to the range."""
    half = max(1, size // 2)

    def equalised(p: np.ndarray) -> np.ndarray:
        bins = 64
        q = np.clip((p * (bins - 1)).astype(int), 0, bins - 1)
        rows, cols = -(-p.shape[0] // half) + 1, -(-p.shape[1] // half) + 1
        curves = np.empty((rows, cols, bins))
        for i in range(rows):
            for j in range(cols):
                block = q[max(0, i * half - half) : i * half + half, max(0, j * half - half) : j * half + half]
                h = np.bincount(block.ravel(), minlength=bins).astype(float)
                most = max(1.0, clip * h.sum())
                extra = np.maximum(h - most, 0).sum()
                c = np.cumsum(np.minimum(h, most) + extra / bins)
                curves[i, j] = c / c[-1]
        y, x = np.mgrid[0 : p.shape[0], 0 : p.shape[1]] / half
        i, j = y.astype(int), x.astype(int)
        fy, fx = y - i, x - j
        top = curves[i, j, q] * (1 - fx) + curves[i, j + 1, q] * fx
        return top * (1 - fy) + (curves[i + 1, j, q] * (1 - fx) + curves[i + 1, j + 1, q] * fx) * fy

    if edge % half:
        raise ValueError("the tile edge must be a multiple of half the window")
    reach = 2 * half
    return with_halo(normalize_input(tiles, low, high), reach, edge, equalised)


#: The order in which kinds of overlays are painted, from below.
OVERLAYS = {"mask": 2, "cell": 3, "type": 4}


def overlay_tiles(label_tiles: DataFrame, layers: DataFrame, colours: DataFrame) -> DataFrame:
    """Label tiles (with a column `layer`) with the colours of the cells in them, to be painted by composite_rgb.

    layers: (layer, kind, opacity), one row a layer, kind one of OVERLAYS. Labels of a `mask` each get a colour by their
    number; those of `cell` and `type` layers get the one in colours (image_id, layer, cell_id, r, g, b), and cells without one
    aren't painted. Only the labels of each tile meet their colours, so that cells are shuffled and never broadcast.
    """
    place = ("image_id", "level", "ty", "tx", "layer")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            labels = [np.unique(plane_of(r)) for r in rows]
            owner = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in labels]))
            found = np.concatenate(labels).astype(np.int64) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in (*place, "kind")), pa.array(found)], [*place, "kind", "cell_id"])

    known = label_tiles.join(F.broadcast(layers), "layer")  # one row a layer
    schema = known.select(*place, "kind").withColumn("cell_id", F.lit(0).cast("long")).schema
    cells = known.select(*place, "kind", "h", "w", "dtype", "pixels").mapInArrow(held, schema).where("cell_id > 0")
    part = [F.col("cell_id") * F.lit(x) - F.floor(F.col("cell_id") * F.lit(x)) for x in (0.6180339887, 0.7548776662, 0.569840291)]
    own = cells.where("kind = 'mask'").select(*place, "cell_id", *(x.alias(c) for x, c in zip(part, "rgb", strict=True)))
    given = cells.where("kind <> 'mask'").join(colours, ["image_id", "layer", "cell_id"]).select(*place, "cell_id", "r", "g", "b")
    palettes = own.unionByName(given).groupBy(*place).agg(F.collect_list(F.struct("cell_id", "r", "g", "b")).alias("palette"))  # the cells of a tile
    order = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in OVERLAYS.items()))
    return known.join(palettes, list(place)).select(*place, "h", "w", "dtype", "pixels", order.alias("order"), F.col("opacity").cast("double").alias("opacity"), "palette")


def composite_rgb(tiles: DataFrame, channels: DataFrame, brightness: float = 1.0, overlays: DataFrame | None = None) -> DataFrame:
    """8-bit RGB tiles (image_id, level, ty, tx, h, w, rgb): the channels' colours by coverage, scaled by brightness / n.

    channels: (channel_idx, r, g, b from 0 to 1, data_min, data_max, range_min, range_max, alpha). overlays, of overlay_tiles,
    are blended over the sum before it is clipped, by their kinds' order, then by layer; where one has another extent, over
    what both share.
    """
    joined = tiles.join(F.broadcast(channels), "channel_idx")  # one row a channel
    if overlays is not None:
        joined = joined.unionByName(overlays, allowMissingColumns=True)

    def paint(rows: pa.Table) -> pa.Table:
        every = rows.to_pylist()
        parts = [p for p in every if p.get("order") is None]
        first = parts[0] if parts else every[0]
        out = np.zeros((first["h"], first["w"], 3))
        for p in parts:
            v = plane_of(p).astype(np.float64)
            span = p["data_max"] - p["data_min"]
            s = np.clip((v - p["data_min"]) / span, 0, 1) if span > 0 else np.zeros_like(v)
            width = p["range_max"] - p["range_min"]
            a = np.clip((s - p["range_min"]) / width, 0, 1) if width > 0 else (s >= p["range_max"]).astype(float)
            out += p["alpha"] * a[:, :, None] * np.array([p["r"], p["g"], p["b"]])
        out = out * brightness / max(1, len(parts))
        for p in sorted((p for p in every if p.get("order") is not None), key=lambda p: (p["order"], p["layer"])):
            labels = plane_of(p)[: first["h"], : first["w"]]
            held, place = np.unique(labels, return_inverse=True)
            palette = {c["cell_id"]: (c["r"], c["g"], c["b"]) for c in p["palette"]}
            colours = np.array([palette.get(int(x), (0, 0, 0)) for x in held], np.float64)[place.reshape(labels.shape)]
            active = np.isin(labels, list(palette))
            under = out[: labels.shape[0], : labels.shape[1]]
            under[active] = (1 - p["opacity"]) * under[active] + p["opacity"] * colours[active]
        out = np.clip(out, 0, 1) * 255
        row = {k: first[k] for k in ("image_id", "level", "ty", "tx", "h", "w")} | {"rgb": out.astype(np.uint8).tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("image_id", pa.string()), *((c, pa.int32()) for c in ("level", "ty", "tx", "h", "w")), ("rgb", pa.binary())]))

    return joined.groupBy("image_id", "level", "ty", "tx").applyInArrow(paint, "image_id string, level int, ty int, tx int, h int, w int, rgb binary")


def retile(tiles: DataFrame, edge: int) -> DataFrame:
    """The same pixels in tiles of another edge."""
    out_schema = tiles.select(*KEYS, "y0", "x0", "h", "w", "dtype", "pixels").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                plane, out = plane_of(r), []
                for ty in range(r["y0"] // edge, (r["y0"] + r["h"] - 1) // edge + 1):
                    for tx in range(r["x0"] // edge, (r["x0"] + r["w"] - 1) // edge + 1):
                        a, b = max(r["y0"], ty * edge), min(r["y0"] + r["h"], (ty + 1) * edge)
                        c, d = max(r["x0"], tx * edge), min(r["x0"] + r["w"], (tx + 1) * edge)
                        piece = plane[a - r["y0"] : b - r["y0"], c - r["x0"] : d - r["x0"]]
                        out.append(r | {"ty": ty, "tx": tx, "y0": a, "x0": c, "h": b - a, "w": d - c, "pixels": piece.tobytes()})
                yield pa.RecordBatch.from_pylist(out, batch.schema)

    def put(rows: pa.Table) -> pa.Table:
        pieces = rows.to_pylist()
        y0, x0 = min(p["y0"] for p in pieces), min(p["x0"] for p in pieces)
        y1, x1 = max(p["y0"] + p["h"] for p in pieces), max(p["x0"] + p["w"] for p in pieces)
        whole = np.zeros((y1 - y0, x1 - x0), np.dtype(pieces[0]["dtype"]).newbyteorder("<"))
        for p in pieces:
            whole[p["y0"] - y0 : p["y0"] - y0 + p["h"], p["x0"] - x0 : p["x0"] - x0 + p["w"]] = plane_of(p)
        return pa.Table.from_pylist([pieces[0] | {"y0": y0, "x0": x0, "h": y1 - y0, "w": x1 - x0, "pixels": whole.tobytes()}], rows.schema)

    plain = tiles.select(*KEYS, "y0", "x0", "h", "w", "dtype", "pixels")
    return plain.mapInArrow(cut, out_schema).groupBy(*KEYS).applyInArrow(put, out_schema)


def resize_nearest(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """(y, x, value) resampled: each new pixel takes the one at floor(y * height / new_height), likewise for x."""
    pixels = pixels.withColumns({c: F.col(c).cast("long") for c in ("y", "x")})  # products of places and sizes exceed an int
    y = F.floor(F.col("ny") * height / new_height)
    x = F.floor(F.col("nx") * width / new_width)
    rows = pixels.withColumn("_a", F.ceil(F.col("y") * new_height / height)).withColumn("ny", F.explode(F.sequence(F.col("_a").cast("long"), F.ceil((F.col("y") + 1) * new_height / height).cast("long"))))
    rows = rows.where(y == F.col("y")).withColumn("_b", F.ceil(F.col("x") * new_width / width)).withColumn("nx", F.explode(F.sequence(F.col("_b").cast("long"), F.ceil((F.col("x") + 1) * new_width / width).cast("long"))))
    inside = (F.col("ny") < new_height) & (F.col("nx") < new_width)
    return rows.where((x == F.col("x")) & inside).select(F.col("ny").alias("y"), F.col("nx").alias("x"), "value")
