"""One mask out of several: windows choose, clashes are judged again, and the chosen cells are painted.

1. The best mask of each window admits its cells whose centre is in the window, or near its edge.
2. An admitted cell clashes with those whose centres lie within its radius, if they are of two masks or more and these cover
   more than three pixels of the box round the centres. A cell belongs to the first clash, in the order of admission, that
   it is in. The masks of a clash are judged again in a box round its first cell; cells of the others go.
3. What a cell's mask shows at its centre is painted within REACH pixels, later admissions over earlier ones.

Boxes and runs meet in blocks of a few rows and columns; painting takes a tile of runs at a time. No pixel is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoframe.operators import runs as L
from histoframe.operators.runs import images
from histoframe.scratch import Scratch

REACH = 100
TILE = 512
BLOCK = 16, 32  # rows and columns of pixels of a bucket in which boxes meet runs; boxes are a few cells wide


def _extent(runs: DataFrame, im: list[str], size: tuple[int, int] | None) -> DataFrame:
    """(image, height, width, reach): what is given, or what the runs reach; `reach` is always the latter's width."""
    found = runs.groupBy(*im).agg((F.max("y") + 1).alias("height"), F.max("x1").alias("width"), F.max("x1").alias("reach"))
    return found if size is None else found.withColumns({"height": F.lit(size[0]).cast("long"), "width": F.lit(size[1]).cast("long")})


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on the image's key; of the one row on the right where there is no such key."""
    return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))


def _present(column: str, masks: list[str]) -> dict[str, Column]:
    """Aggregates that tell of each mask by its place whether it occurs; a set of names would be sorted for."""
    return {f"has_{k}": F.max(F.col(column) == mask) for k, mask in enumerate(masks)}


def _names(masks: list[str]) -> Column:
    """The array of the masks that `_present` found."""
    return F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), F.lit(mask)) for k, mask in enumerate(masks))).cast("array<string>"))


def _cut_to_boxes(boxes: DataFrame, runs: DataFrame, keys: list[str], extra: list[str], on: list[str] | None = None) -> DataFrame:
    """(keys, extra, y, mask_id, label, x0, x1): what of the runs lies in boxes (y_lo, y_hi, x_lo, x_hi, ends exclusive).

    on: further columns that boxes and runs share.
    """
    im, (high, wide) = images(runs), BLOCK
    columns = F.sequence(F.floor(F.col("x_lo") / wide), F.floor((F.col("x_hi") - 1) / wide))
    asked = boxes.where("y_hi > y_lo and x_hi > x_lo").withColumn("by", F.explode(F.sequence(F.floor(F.col("y_lo") / high), F.floor((F.col("y_hi") - 1) / high))))
    asked = asked.withColumn("bx", F.explode(columns))
    own = runs.withColumn("bx", F.explode(F.sequence(F.floor(F.col("x0") / wide), F.floor((F.col("x1") - 1) / wide))))
    own = own.select(*im, F.floor(F.col("y") / high).alias("by"), "bx", "y", "mask_id", "label", F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    met = asked.join(own, [*im, *(on or []), "by", "bx"]).where("y >= y_lo and y < y_hi and r0 < x_hi and r1 > x_lo")
    x0, x1 = F.greatest("r0", "x_lo", F.col("bx") * wide), F.least("r1", "x_hi", (F.col("bx") + 1) * wide)
    return met.select(*keys, *extra, "y", "mask_id", "label", x0.alias("x0"), x1.alias("x1")).where("x1 > x0")


def _union_length(spans: Column) -> Column:
    """The pixels that an array of (x0, x1) covers."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(s["x1"] - F.greatest(s["x0"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["x1"]).cast("long").alias("end"), (acc["n"] + more).cast("long").alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def admitted_cells(runs: DataFrame, cells: DataFrame, extent: DataFrame, order: DataFrame, default: str | None, merit: str, nsize: int) -> DataFrame:
    """(image, mask_id, label, ord, y_px, x_px, area_px, head, last, first): cells that the windows' best masks admit.

    A window without cells has the mask `default` as its best. The grace around a window is ceil(p32 of all areas * 0.05)
    pixels. `first`, and `last` with ord and head, order the cells by the first and the last window that admits them, row by
    row. Windows and first pixels (`head`) are numbered row by row, so all of this is plain numbers; `first` grows with the
    order, with gaps.
    """
    im = images(runs)
    grace = cells.groupBy(*im).agg(F.ceil(F.percentile("area_px", 0.32) * 0.05).alias("grace"))  # areas are few different numbers
    cells = _same(_same(cells, grace, im), extent, im).join(F.broadcast(order), "mask_id")  # one row a mask
    across = F.floor((F.col("width") - 1) / nsize) + 1
    for axis, at, end in (("wy", "y_px", "height"), ("wx", "x_px", "width")):
        low = F.greatest(F.floor((F.col(at) - F.col("grace")) / nsize), F.lit(0))
        high = F.least(F.ceil((F.col(at) + F.col("grace")) / nsize) - 1, F.floor((F.col(end) - 1) / nsize))
        cells = cells.where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
    stats = L.window_stats(runs, nsize)
    jaccard = L.window_jaccard(runs, nsize) if merit == "j1" else None
    winners = L.window_winner(stats, jaccard, order, merit).select(*im, "wy", "wx", F.col("mask_id").alias("winner"))
    near = cells.join(winners, [*im, "wy", "wx"], "left").where(F.coalesce("winner", F.lit(default)) == F.col("mask_id"))
    place = F.col("wy") * across + F.col("wx")
    found = near.groupBy(*im, "mask_id", "label", "ord", "y_px", "x_px", "area_px", "head").agg(F.min(place).alias("a"), F.max(place).alias("last"))
    return found.orderBy("a", "ord", "head", *im).drop("a").withColumn("first", F.monotonically_increasing_id())


def clashes(admitted: DataFrame, runs: DataFrame, extent: DataFrame, masks: list[str]) -> DataFrame:
    """The admitted cells that are in a clash, with `at`: the `first` of the cell whose clash each belongs to."""
    im = images(runs)
    near = L.near_cells(admitted.withColumn("cell_id", F.col("first")), within_masks=True, left=["first"], right=["mask_id", "label", "ord", "y_px", "x_px", "first"])
    near = near.withColumnRenamed("a_first", "at")
    key = [*im, "at"]
    sides = {"lo": F.min("b_ord"), "hi": F.max("b_ord"), "ya": F.min("b_y_px"), "yb": F.max("b_y_px"), "xa": F.min("b_x_px"), "xb": F.max("b_x_px")} | _present("b_mask_id", masks)
    box = near.groupBy(*key).agg(*(v.alias(c) for c, v in sides.items())).where("lo < hi")
    box = _same(box, extent, im)
    low = {f"{v}_lo": F.greatest((F.col(f"{v}a") - 2).cast("long"), F.lit(0)) for v in "yx"}
    high = {f"{v}_hi": F.least((F.col(f"{v}b") + 2).cast("long"), F.col(end)) for v, end in (("y", "height"), ("x", "width"))}
    box = box.withColumns(low | high).select(*key, "y_lo", "y_hi", "x_lo", "x_hi", _names(masks).alias("masks"))
    cut = _cut_to_boxes(box, runs, key, ["masks"]).where(F.array_contains("masks", F.col("mask_id")))
    covered = cut.groupBy(*key, "y").agg(_union_length(F.collect_list(F.struct("x0", "x1"))).alias("n")).groupBy(*key).agg(F.sum("n").alias("n")).where("n > 3")  # a box is a few cells wide
    own = ["mask_id", "label", "ord", "y_px", "x_px", "first"]
    return near.join(covered.select(*key), key).groupBy(*im, *(F.col(f"b_{c}").alias(c) for c in own)).agg(F.min("at").alias("at"))


def judged(members: DataFrame, runs: DataFrame, extent: DataFrame, order: DataFrame, masks: list[str], merit: str, nsize: int) -> DataFrame:
    """(image, first): cells of clashes whose mask isn't the best in the box of `nsize` round their clash's first cell."""
    im = images(runs)
    group = [*im, "at"]
    heads = members.groupBy(*group).agg(F.min("first").alias("first"), *(v.alias(c) for c, v in _present("mask_id", masks).items()))
    heads = heads.select(*group, "first", _names(masks).alias("options")).join(members.select(*im, "first", "y_px", "x_px"), [*im, "first"])
    heads = _same(heads, extent, im)
    for v, end in (("y", "height"), ("x", "width")):
        at = F.col(f"{v}_px")
        heads = heads.withColumn(f"{v}_lo", F.greatest((at - nsize / 2).cast("long"), F.lit(0)))
        stop = (at + nsize / 2).cast("long")
        heads = heads.withColumn(f"{v}_hi", F.when(stop > F.col(end) - nsize / 2, F.col(end)).otherwise(stop))
    cut = _cut_to_boxes(heads.select(*group, "y_lo", "y_hi", "x_lo", "x_hi"), runs, group, [])
    stats = L.stats_of_cuts(cut, group)
    if merit == "j1":
        best = L.jaccard_winner(stats, L.jaccard_of_cuts(cut, group), order, group)
    else:
        score = F.coalesce(F.col({"pop": "n_labels", "cstd": "evenness"}[merit]).cast("double"), F.lit({"pop": 1.0, "cstd": 0.0}[merit]))
        asked = heads.select(*group, F.explode("options").alias("mask_id")).join(F.broadcast(order), "mask_id")
        scored = asked.join(stats, [*group, "mask_id"], "left").withColumn("score", score)
        best = scored.groupBy(*group).agg(F.min_by("mask_id", F.struct(-F.col("score"), F.col("ord"))).alias("mask_id"))
    lost = members.join(best.select(*group, F.col("mask_id").alias("best")), group).where("mask_id <> best")
    return lost.select(*im, "first")


def _painted(pieces: DataFrame, im: list[str]) -> DataFrame:
    """(image, y, x0, x1, label, method, side): pieces (y, x0, x1, label, method, last, ord, head) painted in the order of the last three."""
    schema = "".join(f"{c} string, " for c in im) + "y long, x0 long, x1 long, label long, method string, side boolean"

    def paint(rows: pa.Table) -> pa.Table:
        y, x0, x1, labels = (rows[c].to_numpy() for c in ("y", "x0", "x1", "label"))
        methods = rows["method"].to_pylist()
        top, left = rows["ty"][0].as_py() * TILE, rows["tx"][0].as_py() * TILE
        out = np.full((TILE, TILE), -1, np.int64)
        for k in np.lexsort([rows[c].to_numpy() for c in ("head", "ord", "last")]):
            out[y[k] - top, x0[k] - left : x1[k] - left] = k
        named = np.where(out >= 0, labels[out], 0)
        edges = np.diff(np.pad(named, ((0, 0), (1, 1))), axis=1) != 0
        ys, xs = np.nonzero(edges)
        same = ys[1:] == ys[:-1]
        ys, a, b = ys[:-1][same], xs[:-1][same], xs[1:][same]
        kept = named[ys, a] > 0 if len(ys) else np.zeros(0, bool)
        ys, a, b = ys[kept], a[kept], b[kept]
        columns = [pa.array([rows[c][0].as_py()] * len(ys), pa.string()) for c in im]
        columns += [pa.array(v) for v in (ys + top, a + left, b + left, named[ys, a])]
        columns += [pa.array([methods[k] for k in out[ys, a]], pa.string()), pa.array((a == 0) | (b == TILE))]
        return pa.Table.from_arrays(columns, [*im, "y", "x0", "x1", "label", "method", "side"])

    cut = pieces.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor((F.col("x1") - 1) / TILE)))).withColumn("ty", F.floor(F.col("y") / TILE))
    cut = cut.select(*im, "ty", "tx", "y", F.greatest("x0", F.col("tx") * TILE).cast("long").alias("x0"), F.least("x1", (F.col("tx") + 1) * TILE).cast("long").alias("x1"), F.col("label").cast("long").alias("label"), "method", "last", "ord", "head")
    return cut.groupBy(*im, "ty", "tx").applyInArrow(paint, schema)


def fuse_masks(runs: DataFrame, order: DataFrame, merit: str = "pop", nsize: int = 40, size: tuple[int, int] | None = None) -> DataFrame:
    """(image, mask_id `fused`, y, x0, x1, label, method): one mask out of several; `method` is the mask that a cell is of.

    order: (mask_id, ord). merit: pop, cstd or j1, as window_winner says. size: height and width of the images, else what
    the masks reach. Labels are a cell's own plus the offset of its mask, so they don't depend on chance. Cells whose mask has
    nothing at their centre (two by two pixels up to it) aren't painted. Runs of a mask may not overlap.
    """
    im = images(runs)
    scratch = Scratch(runs.sparkSession, "fusion")
    masks = [r.mask_id for r in order.orderBy("ord").collect()]  # one row a mask
    numbers = {c: F.col(c).cast("long") for c in ("y", "x0", "x1", "label")}
    own = runs.where("x1 > x0 and label > 0").select(*im, "mask_id", *(v.alias(c) for c, v in numbers.items()))
    own = scratch.table(own, "own")  # every step reads the runs; they are worked out once
    extent = scratch.table(_extent(own, im, size), "extent")
    n, head = F.col("x1") - F.col("x0"), F.col("y") * F.col("reach") + F.col("x0")
    cells = _same(own, extent.select(*im, "reach"), im).groupBy(*im, "mask_id", "label").agg(F.sum(n).alias("area_px"), (F.sum(n * F.col("y")) / F.sum(n)).alias("y_px"), (F.sum(n * (F.col("x0") + F.col("x1") - 1)) / F.sum(n) / 2).alias("x_px"), F.min(head).alias("head"))
    cells = scratch.table(cells, "cells")
    admitted = scratch.table(admitted_cells(own, cells, extent, order, masks[0] if masks else None, merit, nsize), "admitted")
    members = scratch.table(clashes(admitted, own, extent, masks), "clashes")
    lost = judged(members, own, extent, order, masks, merit, nsize)
    kept = scratch.table(admitted.join(lost, [*im, "first"], "left_anti"), "kept")

    cell = [*im, "mask_id", "label"]
    cy, cx = (F.greatest(F.col(c).cast("long"), F.lit(1)) for c in ("y_px", "x_px"))
    seats = kept.select(*im, "mask_id", F.col("label").alias("cell"), cy.alias("cy"), cx.alias("cx"), "last", "ord", "head")
    centre = seats.withColumns({"y_lo": F.col("cy") - 1, "y_hi": F.col("cy") + 1, "x_lo": F.col("cx") - 1, "x_hi": F.col("cx") + 1})
    seat = ["cell", "cy", "cx", "last", "ord", "head"]
    shown = _cut_to_boxes(centre, own, im, seat, ["mask_id"]).groupBy(*im, "mask_id", *seat).agg(F.max("label").alias("label"))
    near = shown.join(own, cell).where((F.col("y") >= F.col("cy") - REACH) & (F.col("y") < F.col("cy") + REACH))
    offsets = F.broadcast(L.offsets(own, order).drop("ord")) if not im else L.offsets(own, order).drop("ord")
    pieces = near.join(offsets, [*im, "mask_id"]).select(*im, "y", F.greatest("x0", F.col("cx") - REACH).alias("x0"), F.least("x1", F.col("cx") + REACH).alias("x1"), (F.col("cell") + F.col("id_offset")).alias("label"), F.col("mask_id").alias("method"), "last", "ord", "head").where("x1 > x0")

    painted = scratch.table(_painted(pieces, im), "painted")
    row = Window.partitionBy(*im, "y", "label", "method").orderBy("x0")
    cut = painted.where("side").withColumn("new", F.coalesce(F.lag("x1").over(row) != F.col("x0"), F.lit(True)).cast("int"))
    cut = cut.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.groupBy(*im, "y", "label", "method", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    columns = [*im, F.lit("fused").alias("mask_id"), "y", "x0", "x1", "label", "method"]
    return painted.where("not side").select(*columns).unionByName(cut.select(*columns))
