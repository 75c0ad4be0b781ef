"""Label maps: segmentation, components, object clean-up, expansion, contours, and models supplied by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.operators import tiles as T
from histoframe.operators.flooding import expand_separated, label_voronoi_otsu  # noqa: F401
from histoframe.operators.parts import joined_parts, parts_in_runs, parts_in_tiles
from histoframe.operators.ranks import tile_histogram
from histoframe.operators.runs import images, to_runs
from histoframe.operators.thresholds import otsu_of
from histoframe.scratch import Scratch


def connected_components(runs: DataFrame) -> DataFrame:
    """Foreground runs relabelled from 1 in each mask of each image by connected parts, corners included.

    Runs of a row that overlap or touch are one, whatever their labels. Parts are numbered in reading order of their first
    pixels.
    """
    return joined_parts(parts_in_runs(runs), Scratch(runs.sparkSession, "label-components"))


def components_of_tiles(tiles: DataFrame, mask_id: str) -> DataFrame:
    """Runs of the connected parts of tiles' pixels that aren't 0, corners included; a mask a channel and image."""
    return joined_parts(parts_in_tiles(tiles, lambda p, _: p != 0, _named(mask_id)), Scratch(tiles.sparkSession, "tile-components"))


def _named(mask_id: str) -> Callable[[dict], str]:
    """The mask's name for a channel: the first has none of its own."""
    return lambda r: f"{mask_id}_{r['channel_idx']}" if r["channel_idx"] > 0 else mask_id


def label_gauss_otsu(tiles: DataFrame, edge: int, sigma: float = 2, factor: float = 1) -> DataFrame:
    """Runs of the parts of each blurred channel above its own Otsu threshold times a factor; a mask a channel and image.

    The threshold is of all pixels, in 256 bins over the channel's range.
    """
    scratch = Scratch(tiles.sparkSession, "gauss-otsu")
    blurred = scratch.table(T.gaussian(tiles, edge, sigma), "blurred")
    plane = F.struct("image_id", "channel_idx").alias("marker")
    found = otsu_of(tile_histogram(blurred, scratch).select(plane, "lo", "hi", "bin", "h", "c"))
    limit = scratch.table(found.select("marker.*", (F.col("threshold") * factor).alias("_t")), "limits")
    above = parts_in_tiles(blurred.join(limit, ["image_id", "channel_idx"]), lambda p, r: p > r["_t"], _named("gauss_otsu"))
    return joined_parts(above, scratch)


def label_runs(tiles: DataFrame, mask_id: str) -> DataFrame:
    """Runs of label tiles; runs of one row and label that touch across tiles are joined."""
    values = T.pixel_values(tiles).where("value > 0")
    return to_runs(values.select("image_id", F.lit(mask_id).alias("mask_id"), "y", "x", F.col("value").cast("long").alias("label")))


def owned(objects: DataFrame, edge: int) -> DataFrame:
    """Objects of overlapping tiles, each kept by the tile whose inner box holds its integer centroid."""
    y, x = F.floor("y_px"), F.floor("x_px")
    return objects.where((F.floor(y / edge) == F.col("ty")) & (F.floor(x / edge) == F.col("tx")))


def infer_tiles(tiles: DataFrame, edge: int, overlap: int, model: Callable[[np.ndarray], np.ndarray], dtype: str = "float32") -> DataFrame:
    """A user's model over tiles with `overlap` pixels around; it maps an array to one of its shape."""
    return T.with_halo(tiles, overlap, edge, model, dtype)


def score_mean(tiles: DataFrame, tile: int, overlap: int, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, channel_idx, y, x, value): scores averaged where model windows of tile + 2 * overlap pixels cover a pixel
    more than once."""
    schema = "image_id string, channel_idx int, y int, x int, value double"

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            scores = model(T.plane_of(r).astype(np.float64))
            y, x = np.mgrid[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
            n = y.size
            out.append(pa.table({"image_id": pa.array([r["image_id"]] * n, pa.string()), "channel_idx": pa.array(np.full(n, r["channel_idx"], np.int32)), "y": pa.array(y.ravel().astype(np.int32)), "x": pa.array(x.ravel().astype(np.int32)), "value": pa.array(scores.ravel().astype(np.float64))}))
        return pa.concat_tables(out)

    plane = ["image_id", "channel_idx"]
    return _windows(tiles, tile, overlap).groupBy(*plane, "ty", "tx").applyInArrow(run, schema).groupBy(*plane, "y", "x").agg(F.avg("value").alias("value"))


def _windows(tiles: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Tiles grown by the overlap where the image goes on, with their new places."""
    grown = T.with_halo(tiles, overlap, tile, lambda p: p, "float32")
    values = T.pixel_values(grown)
    near = values.withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - overlap) / tile), F.floor((F.col("y") + overlap) / tile))))
    near = near.withColumn("tx", F.explode(F.sequence(F.floor((F.col("x") - overlap) / tile), F.floor((F.col("x") + overlap) / tile))))
    plane = ["image_id", "channel_idx"]
    near = near.join(tiles.select(*plane, "ty", "tx").distinct(), [*plane, "ty", "tx"], "left_semi")

    def put(rows: pa.Table) -> pa.Table:
        y, x, v = (rows[c].to_numpy() for c in ("y", "x", "value"))
        out = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), "<f4")
        out[y - y.min(), x - x.min()] = v
        row = {c: rows[c][0].as_py() for c in (*plane, "ty", "tx")} | {"y0": int(y.min()), "x0": int(x.min()), "h": out.shape[0], "w": out.shape[1], "dtype": "float32", "pixels": out.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("image_id", pa.string()), ("channel_idx", pa.int32()), ("ty", pa.int64()), ("tx", pa.int64()), *((c, pa.int32()) for c in ("y0", "x0", "h", "w")), ("dtype", pa.string()), ("pixels", pa.binary())]))

    return near.groupBy(*plane, "ty", "tx").applyInArrow(put, "image_id string, channel_idx int, ty long, tx long, y0 int, x0 int, h int, w int, dtype string, pixels binary")


# ---- per object, on the runs of one label at a time


def _per_object(runs: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each object's crop through a function of a boolean array; objects are small, and each is one group."""

    def run(rows: pa.Table) -> pa.Table:
        y, x0, x1 = (rows[c].to_numpy().astype(int) for c in ("y", "x0", "x1"))
        crop = np.zeros((y.max() - y.min() + 1, x1.max() - x0.min()), bool)
        for a, b, c in zip(y - y.min(), x0 - x0.min(), x1 - x0.min(), strict=True):
            crop[a, b:c] = True
        edges = np.diff(np.pad(f(crop).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        ys, starts = np.nonzero(edges == 1)
        _, stops = np.nonzero(edges == -1)
        n = len(ys)
        return pa.table({c: pa.array([rows[c][0].as_py()] * n, pa.string()) for c in mask} | {"y": pa.array((ys + y.min()).astype(np.int64)), "x0": pa.array((starts + x0.min()).astype(np.int64)), "x1": pa.array((stops + x0.min()).astype(np.int64)), "label": pa.array([rows["label"][0].as_py()] * n, pa.int64())})

    mask = [*images(runs), "mask_id"]
    plain = runs.select(*mask, *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1", "label")))
    return plain.groupBy(*mask, "label").applyInArrow(run, "".join(f"{c} string, " for c in mask) + "y long, x0 long, x1 long, label long")


def _parts(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Connected parts of a small boolean array, numbered by spreading the least number."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    around = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    while True:
        low = label.copy()
        padded = np.pad(label, 1)
        for y, x in around:
            s = padded[1 + y : 1 + y + mask.shape[0], 1 + x : 1 + x + mask.shape[1]]
            low = np.where(mask & (s > 0) & (s < low), s, low)
        if (low == label).all():
            return label
        label = low


def clean_objects(runs: DataFrame, fill_holes: bool = False, keep_largest: bool = False) -> DataFrame:
    """Objects with holes filled, and cut to their largest part (the first in reading order among equals)."""

    def f(crop: np.ndarray) -> np.ndarray:
        if fill_holes:
            outside = _parts(~np.pad(crop, 1), corners=False)
            crop = (outside != outside[0, 0])[1:-1, 1:-1]
        if keep_largest:
            parts = _parts(crop, corners=True)
            names, counts = np.unique(parts[parts > 0], return_counts=True)
            crop = parts == names[np.argmax(counts)]
        return crop

    return _per_object(runs, f)


def contours(runs: DataFrame) -> DataFrame:
    """(mask_id, label, part, ring): the outer boundary of each part of an object along pixel centres, at +0.5, three points or more.

    The trace follows the boundary pixels clockwise from the first in reading order, by Moore neighbours.
    """
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]

    def trace(crop: np.ndarray) -> list[tuple[int, int]]:
        padded = np.pad(crop, 1)
        start = tuple(np.argwhere(padded)[0])
        at, came, out = start, 6, [start]
        for _ in range(4 * padded.size):
            for k in range(8):
                d = (came + 5 + k) % 8  # from the step after the one that leads back
                to = (at[0] + steps[d][0], at[1] + steps[d][1])
                if padded[to]:
                    break
            else:
                break
            if at == start and len(out) > 1 and to == out[1]:
                break
            at, came = to, d
            out.append(at)
        if len(out) > 1 and out[-1] == start:
            out.pop()
        return out

    def run(rows: pa.Table) -> pa.Table:
        y, x0, x1 = (rows[c].to_numpy().astype(int) for c in ("y", "x0", "x1"))
        crop = np.zeros((y.max() - y.min() + 1, x1.max() - x0.min()), bool)
        for a, b, c in zip(y - y.min(), x0 - x0.min(), x1 - x0.min(), strict=True):
            crop[a, b:c] = True
        parts = _parts(crop, corners=True)
        rings = [[{"x": float(px - 1 + x0.min() + 0.5), "y": float(py - 1 + y.min() + 0.5)} for py, px in trace(parts == k)] for k in np.unique(parts[parts > 0])]
        kept = [ring for ring in rings if len(ring) >= 3]
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table({c: pa.array([rows[c][0].as_py()] * len(kept), pa.string()) for c in mask} | {"label": pa.array([rows["label"][0].as_py()] * len(kept), pa.int64()), "part": pa.array(range(1, len(kept) + 1), pa.int32()), "ring": pa.array(kept, kind)})

    mask = [*images(runs), "mask_id"]
    plain = runs.select(*mask, "y", "x0", "x1", F.col("label").cast("long").alias("label"))
    return plain.groupBy(*mask, "label").applyInArrow(run, "".join(f"{c} string, " for c in mask) + "label long, part int, ring array<struct<x:double,y:double>>")


def expand_labels(tiles: DataFrame, edge: int, distance: int = 6) -> DataFrame:
    """Background pixels take the nearest label within a distance; the smaller label among equally near ones."""

    def kernel(p: np.ndarray) -> np.ndarray:
        out, last, best = p.astype(np.int64), 0, None
        far = np.iinfo(np.int64).max
        offsets = T.disk(distance)[1:]
        padded = np.pad(out, distance)
        for k, (y, x) in enumerate(offsets):
            s = padded[distance + y : distance + y + p.shape[0], distance + x : distance + x + p.shape[1]]
            d = y * y + x * x
            if d != last and best is not None:
                out = np.where((out == 0) & (best < far), best, out)
                best = None
            last = d
            s = np.where(s > 0, s, far)
            best = s if best is None else np.minimum(best, s)
            if k == len(offsets) - 1:
                out = np.where((out == 0) & (best < far), best, out)
        return out

    return T.with_halo(tiles, distance, edge, kernel, dtype="int64")


def crop_to_region(tiles: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Tiles that a box (y0, x0, y1, x1) overlaps: what segmentation of a window or polygon has to read."""
    y0, x0, y1, x1 = box
    return tiles.where((F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0) & (F.col("x0") < x1) & (F.col("x0") + F.col("w") > x0))


def drop_border(runs: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Runs of the objects that don't touch the edge of a box."""
    y0, x0, y1, x1 = box
    touching = runs.where((F.col("y") <= y0) | (F.col("y") >= y1 - 1) | (F.col("x0") <= x0) | (F.col("x1") >= x1)).select(*images(runs), "mask_id", "label").distinct()
    return runs.join(touching, [*images(runs), "mask_id", "label"], "left_anti").select(*runs.columns)


def classify_cells(tiles: DataFrame, label_tiles: DataFrame, cells: DataFrame, edge: int, model: Callable[[np.ndarray], np.ndarray], crop: int = 64, threshold: float = 0.5, n_side: int = 0) -> DataFrame:
    """(cell_id, channel_idx, p, state): a user's model on the crop around each cell; state 2 from the threshold up.

    The model gets (cells, 2 * n_side + 3, crop, crop): the channel between `n_side` neighbouring channels on either side
    (zeros where there is none), the cell's mask and the mask of other cells; crops are mirrored at image edges. Each cell belongs to the tile of its centroid, whose halo holds the crop. Cells of several images have image_id.
    """
    half = crop // 2
    both = tiles.select(*T.KEYS, "y0", "x0", "h", "w", "dtype", "pixels").unionByName(label_tiles.select("image_id", "level", F.lit(-1).alias("channel_idx"), "ty", "tx", "y0", "x0", "h", "w", "dtype", "pixels"))
    # One pass gives tiles that keep their halo: the kernel's result is only cut by the caller, so views are rebuilt here.
    values = T.pixel_values(both)
    near = values.withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - half) / edge), F.floor((F.col("y") + half) / edge))))
    near = near.withColumn("tx", F.explode(F.sequence(F.floor((F.col("x") - half) / edge), F.floor((F.col("x") + half) / edge))))
    named_images = images(cells)
    keys = [*named_images, "ty", "tx"]
    seats = cells.select(*named_images, "cell_id", F.floor("y_px").cast("int").alias("cy"), F.floor("x_px").cast("int").alias("cx"), F.floor(F.col("y_px") / edge).alias("ty"), F.floor(F.col("x_px") / edge).alias("tx"))

    def run(pixels: pa.Table, seated: pa.Table) -> pa.Table:
        out: dict[str, list] = {"cell_id": [], "channel_idx": [], "p": []}
        if pixels.num_rows and seated.num_rows:
            y, x, c, v = (pixels[k].to_numpy() for k in ("y", "x", "channel_idx", "value"))
            y0, x0 = y.min(), x.min()
            planes = {}
            for k in np.unique(c):
                plane = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1))
                plane[y[c == k] - y0, x[c == k] - x0] = v[c == k]
                planes[int(k)] = np.pad(plane, half, mode="symmetric")
            names = planes.pop(-1, None)
            missing = np.zeros_like(next(iter(planes.values()))) if planes else None
            for channel in planes:
                beside = [planes.get(channel + d, missing) for d in range(-n_side, n_side + 1)]
                batch = []
                for cell, cy, cx in zip(*(seated[k].to_pylist() for k in ("cell_id", "cy", "cx")), strict=True):
                    at = (slice(cy - y0, cy - y0 + crop), slice(cx - x0, cx - x0 + crop))
                    own = names[at] if names is not None else np.zeros((crop, crop))
                    batch.append(np.stack([*(plane[at] for plane in beside), own == cell, (own > 0) & (own != cell)]))
                out["p"] += np.asarray(model(np.stack(batch)), float).ravel().tolist()
                out["cell_id"] += seated["cell_id"].to_pylist()
                out["channel_idx"] += [channel] * seated.num_rows
        n = len(out["cell_id"])
        named = {c: pa.array([seated[c][0].as_py()] * n if n else [], pa.string()) for c in named_images}
        return pa.table(named | {"cell_id": pa.array(out["cell_id"], pa.int64()), "channel_idx": pa.array(out["channel_idx"], pa.int32()), "p": pa.array(out["p"], pa.float64())})

    scored = near.groupBy(*keys).cogroup(seats.groupBy(*keys)).applyInArrow(run, ("image_id string, " if named_images else "") + "cell_id long, channel_idx int, p double")
    return scored.withColumn("state", F.when(F.col("p") >= threshold, 2).otherwise(1))
