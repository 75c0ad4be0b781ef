"""Seeded floods over tiles: nearest seeds along a mask, and cells grown with a line between them.

A flood gives each pixel of a mask the seed that is nearest along the mask, in steps to the four neighbours, and the smallest
of equally near ones. A pixel's key is steps * STEP + seed, so the nearest seed is the least key, whatever the order of work.
Tiles flood by themselves; then those whose border keys fell tell their neighbours, and only tiles with news go on, until
there is none. So a flood reaches as far as its mask, and doesn't depend on tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.operators import runs as L
from histoframe.operators import tiles as T
from histoframe.operators.parts import joined_parts, numbered, parts_in_tiles
from histoframe.operators.planes import each_row, plane_of
from histoframe.scratch import Scratch

STEP = 1 << 40
FAR = 1 << 62
SIDES = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
_LINES = {"up": np.s_[0, :], "down": np.s_[-1, :], "left": np.s_[:, 0], "right": np.s_[:, -1]}
_BACK = {"up": "down", "down": "up", "left": "right", "right": "left"}
_BOX = "y0 int, x0 int, h int, w int"
STATE = f"image_id string, level int, channel_idx int, ty int, tx int, {_BOX}, kind int, side string, mask binary, keys binary"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in STATE.split(", "))])
COMPACT = 4  # rounds after which what changed is written together with what didn't


def spread(mask: np.ndarray, keys: np.ndarray, front: np.ndarray) -> None:
    """Lower the keys of a mask in place, from the pixels in `front` (flat numbers) on; the outermost pixels aren't in the mask."""
    inside, flat = mask.ravel(), keys.ravel()
    while len(front):
        reached = []
        for off in (1, -1, mask.shape[1], -mask.shape[1]):
            to, key = front + off, flat[front] + STEP
            less = inside[to] & (key < flat[to])
            to = to[less]
            np.minimum.at(flat, to, key[less])
            reached.append(to)
        front = np.unique(np.concatenate(reached))


def _news(row: dict, before: np.ndarray | None, keys: np.ndarray) -> list[dict]:
    """Messages (kind 1) to the neighbours of a tile on whose side keys have fallen."""
    out = []
    for side, (dy, dx) in SIDES.items():
        line = keys[_LINES[side]]
        fell = line < (FAR if before is None else before[_LINES[side]])
        if fell.any() and row["ty"] + dy >= 0 and row["tx"] + dx >= 0:
            out.append({k: row[k] for k in ("image_id", "level", "channel_idx")} | {"ty": row["ty"] + dy, "tx": row["tx"] + dx, "kind": 1, "side": _BACK[side], "keys": np.where(fell, line, FAR).tobytes()})
    return out


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mask and keys of a state with a margin of one pixel."""
    shape = row["h"], row["w"]
    mask = np.pad(np.frombuffer(row["mask"], np.uint8).reshape(shape) > 0, 1)
    return mask, np.pad(np.frombuffer(row["keys"], np.int64).reshape(shape), 1, constant_values=FAR)


def _flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first round: each tile by itself."""
    for batch in batches:
        for row in each_row(batch):
            mask, keys = _arrays(row)
            spread(mask, keys, np.flatnonzero(keys.ravel() < FAR))
            own = np.ascontiguousarray(keys[1:-1, 1:-1])
            yield pa.RecordBatch.from_pylist([row | {"keys": own.tobytes()}, *_news(row, None, own)], _SCHEMA)


def _went_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A further round: rows of a tile come together, its state first, then its messages; only tiles with news are given."""
    row, mask, keys, before, front = None, None, None, None, []

    def done() -> Iterator[pa.RecordBatch]:
        if row is not None and front:
            spread(mask, keys, np.unique(np.concatenate(front)))
            own = np.ascontiguousarray(keys[1:-1, 1:-1])
            yield pa.RecordBatch.from_pylist([row | {"keys": own.tobytes()}, *_news(row, before, own)], _SCHEMA)

    place = ("image_id", "level", "channel_idx", "ty", "tx")
    for batch in batches:
        for r in each_row(batch):
            if r["kind"] == 0:
                yield from done()
                row, front = r, []
                mask, keys = _arrays(r)
                before = keys[1:-1, 1:-1].copy()
            elif row is not None and all(row[c] == r[c] for c in place):
                line = np.frombuffer(r["keys"], np.int64) + STEP
                at = np.arange(keys.size).reshape(keys.shape)[1:-1, 1:-1][_LINES[r["side"]]]
                flat = keys.ravel()
                less = mask.ravel()[at] & (line < flat[at])
                flat[at[less]] = line[less]
                front.append(at[less])
    yield from done()


def flood(states: DataFrame, scratch: Scratch) -> DataFrame:
    """The flood of states (STATE, kind 0): `keys` hold seeds or FAR where they come in, and least keys or FAR where they go out."""
    place = ["image_id", "level", "channel_idx", "ty", "tx"]
    first = scratch.table(states.mapInArrow(_flooded, STATE), "flood-0")
    current, last, k = first.where("kind = 0"), first, 0
    while (news := last.where("kind = 1")).limit(1).count():
        k += 1
        told = current.join(news.select(*place).distinct(), place, "left_semi").select(*_NAMES).unionByName(news.select(*_NAMES))
        last = scratch.table(told.repartition(*place).sortWithinPartitions(*place, "kind").mapInArrow(_went_on, STATE), f"flood-{k}")
        changed = last.where("kind = 0")
        current = current.join(changed.select(*place), place, "left_anti").select(*_NAMES).unionByName(changed)
        if k % COMPACT == 0:
            current = scratch.table(current, f"state-{k}")
    return current


def label_tiles_of(states: DataFrame) -> DataFrame:
    """Label tiles of a flood: the seeds' numbers, 0 where none came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                some = batch.slice(k, 1)
                v = np.frombuffer(some["keys"][0].as_py(), np.int64)
                pixels = pa.array([np.where(v < FAR, v % STEP, 0).astype("<i8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in _NAMES[:9]), pa.array(["int64"]), pixels], [*_NAMES[:9], "dtype", "pixels"])

    return states.mapInArrow(run, f"image_id string, level int, channel_idx int, ty int, tx int, {_BOX}, dtype string, pixels binary")


def seeded(tiles: DataFrame, seeds: DataFrame, edge: int) -> DataFrame:
    """States from mask tiles (pixels above 0) and seeds (image_id, channel_idx, y, x0, x1, label)."""
    place = ["image_id", "channel_idx", "ty", "tx"]
    cut = seeds.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / edge), F.floor((F.col("x1") - 1) / edge)))).withColumn("ty", F.floor(F.col("y") / edge))
    cut = cut.select("image_id", "channel_idx", F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), "y", "x0", "x1", "label")

    def put(tile: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for r in tile.to_pylist():
            keys = np.full((r["h"], r["w"]), FAR, np.int64)
            for y, a, b, label in zip(*(own[c].to_pylist() for c in ("y", "x0", "x1", "label")), strict=True):
                line = keys[y - r["y0"], max(0, a - r["x0"]) : max(0, b - r["x0"])]
                np.minimum(line, label, out=line)
            out.append({k: r[k] for k in _NAMES[:9]} | {"kind": 0, "side": None, "mask": (plane_of(r) > 0).astype(np.uint8).tobytes(), "keys": keys.tobytes()})
        return pa.Table.from_pylist(out, _SCHEMA)

    return tiles.select(*_NAMES[:9], "dtype", "pixels").groupBy(*place).cogroup(cut.groupBy(*place)).applyInArrow(put, STATE)


def peaks_of(plane: np.ndarray) -> np.ndarray:
    """Bit 0: no neighbour of the eight is greater. Bit 1: of those, an equal neighbour has a greater one.

    A plateau is a maximum where no part of it has bit 1: neighbours with bit 0 are equal.
    """
    ring = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]
    top = np.ones(plane.shape, bool)
    for s in T._shifted(plane, ring):
        top &= plane >= s
    fails = np.zeros(plane.shape, bool)
    for s, t in zip(T._shifted(plane, ring), T._shifted(top, ring), strict=True):
        fails |= top & (s == plane) & ~t
    return top.astype(np.uint8) | fails.astype(np.uint8) << 1


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bits of two sets of tiles of one grid: the right ones' above those of the left."""
    other = right.select(*T.KEYS, F.col("pixels").alias("_p"))
    joined = left.join(other, list(T.KEYS))
    marked = T.map_tiles(joined, lambda p, r: p | np.frombuffer(r["_p"], np.uint8).reshape(p.shape) << 2)
    return marked.drop("_p")


def label_voronoi_otsu(tiles: DataFrame, edge: int, spot_sigma: float = 2, outline_sigma: float = 2, size: int = 101) -> DataFrame:
    """Label tiles by seeded flooding: seeds are maxima of the image blurred for spots, inside a mask, and flood that mask.

    The mask: the image blurred for outlines, scaled to 0..255 over each channel's range, exceeds its mean in a window of
    `size`, weighted by a Gaussian of (size - 1) / 6, by more than one. A plateau is one maximum; seeds that touch, corners
    included, are one. Labels are numbers of seeds in reading order of their first pixels, from 1 in each channel of an image.
    """
    scratch = Scratch(tiles.sparkSession, "voronoi-otsu")
    blurred = T.with_halo(tiles, int(4 * spot_sigma + 0.5), edge, lambda p: T.gaussian_of(p, spot_sigma), dtype="float64")
    spots = T.with_halo(blurred, 2, edge, peaks_of, dtype="uint8")  # in two steps: beyond the image stand copies of blurred pixels, not nearly equal ones
    outline = scratch.table(T.gaussian(tiles, edge, outline_sigma), "outline")
    scaled = T.map_tiles_with_range(outline, lambda p, a, b: (p - a) / (b - a) * 255 if b > a else np.zeros_like(p))
    wide = (size - 1) / 6
    mask = T.with_halo(scaled, int(4 * wide + 0.5), edge, lambda p: (p > T.gaussian_of(p, wide) + 1).astype(np.uint8), dtype="uint8")
    bits = scratch.table(_both(spots, mask), "bits")

    def named(kind: str):
        return lambda r: f"{kind}:{r['channel_idx']}"

    local = parts_in_tiles(bits, lambda p, _: p & 1 > 0, named("spots")).unionByName(parts_in_tiles(bits, lambda p, _: p & 5 == 5, named("seeds")))
    parts = scratch.table(joined_parts(local, scratch), "parts")
    peaks, seeds = parts.where("mask_id like 'spots:%'"), parts.where("mask_id like 'seeds:%'")
    fails = parts_in_tiles(bits, lambda p, _: p & 2 > 0, named("fails")).select("image_id", "mask_id", "y", "x0", "x1", F.lit(1).alias("label"))
    channel = {c: F.substring_index(c, ":", -1) for c in ("a_mask", "b_mask")}
    same = channel["a_mask"] == channel["b_mask"]
    lost = L.overlaps(peaks, fails).where(same).select("image_id", F.col("a_mask").alias("mask_id"), F.col("a").alias("label")).distinct()
    bad = peaks.join(lost, ["image_id", "mask_id", "label"], "left_semi")
    lost = L.overlaps(seeds, bad).where(same).select("image_id", F.col("a_mask").alias("mask_id"), F.col("a").alias("label")).distinct()
    kept = scratch.table(seeds.join(lost, ["image_id", "mask_id", "label"], "left_anti"), "seeds")
    numbers = scratch.table(numbered(kept, ["image_id", "mask_id", "label"], "n", scratch), "numbers")
    least = numbers.groupBy("image_id", "mask_id").agg(F.min("n").alias("least"))
    names = numbers.join(least, ["image_id", "mask_id"]).select("image_id", "mask_id", "label", (F.col("n") - F.col("least") + 1).alias("name"))
    seeds = kept.join(names, ["image_id", "mask_id", "label"]).select("image_id", F.substring_index("mask_id", ":", -1).cast("int").alias("channel_idx"), "y", "x0", "x1", F.col("name").alias("label"))
    inside = T.map_tiles(bits, lambda p, _: p >> 2 & 1)
    return label_tiles_of(flood(seeded(inside, seeds, edge), scratch))


# ---- growing with a line


def cores_of(p: np.ndarray) -> np.ndarray:
    """A cell's pixels all of whose four neighbours are its own; beyond the image there are none."""
    padded = np.pad(p, 1, mode="symmetric")
    inner = p > 0
    for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0)):
        inner &= padded[1 + y : 1 + y + p.shape[0], 1 + x : 1 + x + p.shape[1]] == p
    return np.where(inner, p, 0)


def grown_of(p: np.ndarray, distance: int) -> np.ndarray:
    """Background within a distance of a label, ring by ring: a pixel takes the label of the neighbour of the four that is
    nearest to the labels, the smallest of equally near ones."""
    far = distance * distance + 1
    near = np.where(p > 0, 0, far)
    padded = np.pad(p > 0, distance)
    for y, x in T.disk(distance):
        hit = padded[distance + y : distance + y + p.shape[0], distance + x : distance + x + p.shape[1]]
        near = np.where(hit, np.minimum(near, y * y + x * x), near)
    out = p.astype(np.int64).copy()
    big = np.int64(FAR)
    for ring in sorted({y * y + x * x for y, x in T.disk(distance)} - {0}):
        at = near == ring
        if not at.any():
            continue
        keys = np.pad(np.where(out > 0, near * np.int64(STEP) + out, big), 1, constant_values=big)
        best = np.min([keys[1 + y : 1 + y + p.shape[0], 1 + x : 1 + x + p.shape[1]] for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))], axis=0)
        out = np.where(at & (best < big), best % STEP, out)
    return out


def line_of(p: np.ndarray) -> np.ndarray:
    """A label's pixels beside a smaller label become 0."""
    padded = np.pad(p, 1, mode="symmetric")
    line = np.zeros(p.shape, bool)
    for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0)):
        s = padded[1 + y : 1 + y + p.shape[0], 1 + x : 1 + x + p.shape[1]]
        line |= (s > 0) & (s < p)
    return np.where(line, 0, p)


def _lost_cells(tiles: DataFrame, cores: DataFrame) -> DataFrame:
    """(image_id, channel_idx, y, x0, x1, label): a seed for each cell without a core.

    The seed is the cell's pixel nearest to its truncated centroid, which is that pixel itself where it is the cell's.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                p, core = plane_of(r), np.frombuffer(r["_p"], np.int64)
                names, of = np.unique(p, return_inverse=True)
                y, x = np.mgrid[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
                n, sy, sx = np.bincount(of.ravel()), np.bincount(of.ravel(), y.ravel()), np.bincount(of.ravel(), x.ravel())
                keep = names > 0
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * k, pa.string()), pa.array(np.full(k, r["channel_idx"], np.int32)), pa.array(names[keep].astype(np.int64)), pa.array(n[keep]), pa.array(sy[keep]), pa.array(sx[keep]), pa.array(np.isin(names[keep], core))], ["image_id", "channel_idx", "label", "n", "sy", "sx", "core"])

    keys = ["image_id", "channel_idx", "label"]
    joined = tiles.join(cores.select(*T.KEYS, F.col("pixels").alias("_p")), list(T.KEYS))
    cells = joined.mapInArrow(sums, "image_id string, channel_idx int, label long, n long, sy double, sx double, core boolean").groupBy(*keys)
    lost = cells.agg(F.floor(F.sum("sy") / F.sum("n")).alias("cy"), F.floor(F.sum("sx") / F.sum("n")).alias("cx"), F.max("core").alias("core")).where("not core").select(*keys, "cy", "cx")
    own = T.pixel_values(tiles).where("value > 0").select("image_id", "channel_idx", F.col("value").cast("long").alias("label"), "y", "x").join(lost, keys)
    away = (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2
    return own.groupBy(*keys).agg(F.min(F.struct(away.alias("d"), "y", "x")).alias("s")).select("image_id", "channel_idx", F.col("s.y").cast("long").alias("y"), F.col("s.x").cast("long").alias("x0"), (F.col("s.x") + 1).cast("long").alias("x1"), "label")


def expand_separated(tiles: DataFrame, edge: int, distance: int = 6) -> DataFrame:
    """Cells grown by a distance, with a line of one pixel, 0, between those that touch.

    Cells are flooded anew from their cores, the pixels whose four neighbours are the cell's too, along all labelled pixels;
    a cell without a core is seeded at its truncated centroid, or at its pixel nearest to that. Parts that no flood reaches
    keep their label. Then the background is taken ring by ring, nearest pixels first. Of two cells that touch the one of
    the greater label gives up its pixels beside the other.
    """
    scratch = Scratch(tiles.sparkSession, "expand-separated")
    labels = T.map_tiles(tiles.select(*T.KEYS, "y0", "x0", "h", "w", "dtype", "pixels"), lambda p, _: p.astype(np.int64))
    labels = scratch.table(labels, "labels")
    cores = scratch.table(T.with_halo(labels, 1, edge, cores_of, dtype="int64"), "cores")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                p = np.pad(plane_of(r), ((0, 0), (1, 1)))
                y, x = np.nonzero(np.diff(p, axis=1))
                same = y[1:] == y[:-1]
                y, a, b = y[:-1][same], x[:-1][same], x[1:][same]
                kept = p[y, a + 1] > 0
                y, a, b = y[kept], a[kept], b[kept]
                k = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * k, pa.string()), pa.array(np.full(k, r["channel_idx"], np.int32)), pa.array(y + r["y0"]), pa.array(a + r["x0"]), pa.array(b + r["x0"]), pa.array(p[y, a + 1])], ["image_id", "channel_idx", "y", "x0", "x1", "label"])

    seeds = cores.mapInArrow(runs, "image_id string, channel_idx int, y long, x0 long, x1 long, label long").unionByName(_lost_cells(labels, cores))
    found = label_tiles_of(flood(seeded(labels, seeds, edge), scratch))
    joined = found.join(labels.select(*T.KEYS, F.col("pixels").alias("_p")), list(T.KEYS))
    whole = T.map_tiles(joined, lambda p, r: np.where(p > 0, p, np.frombuffer(r["_p"], np.int64).reshape(p.shape))).drop("_p")
    whole = scratch.table(whole, "whole")
    grown = T.with_halo(whole, 3 * distance, edge, lambda p: grown_of(p, distance), dtype="int64")
    return T.with_halo(grown, 1, edge, line_of, dtype="int64")
