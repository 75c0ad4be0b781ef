"""Masks as label runs: (mask_id, y, x0, x1, label), x1 exclusive, label above 0. Everything here is joins and groupings.

Runs of several images have a further column image_id: masks of different images never meet, and results carry it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIP = 256  # columns of pixels that one bucket of a run join covers
SWEEP = 4_096  # rows that a sweep over sorted runs takes at once


def images(*tables: DataFrame) -> list[str]:
    """The key of images, where all tables have it."""
    return ["image_id"] if all("image_id" in t.columns for t in tables) else []


def to_runs(pixels: DataFrame) -> DataFrame:
    """Run-length encoding of (mask_id, y, x, label) pixels: gaps and islands over each row; label 0 is background."""
    keys = [*images(pixels), "mask_id", "y"]
    w = Window.partitionBy(*keys).orderBy("x")
    new = (F.coalesce(F.lag("label").over(w), F.lit(0)) != F.col("label")) | (F.coalesce(F.lag("x").over(w), F.col("x") - 2) != F.col("x") - 1)
    island = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pixels.where("label > 0").withColumn("_island", island).groupBy(*keys, "_island", "label").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select(*keys, "x0", "x1", "label")


def to_pixels(runs: DataFrame) -> DataFrame:
    """(mask_id, y, x, label) of every labelled pixel."""
    return runs.where("x1 > x0").select(*images(runs), "mask_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), "label")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for at in range(0, batch.num_rows, SWEEP):
            yield pa.Table.from_arrays(batch.slice(at, SWEEP).columns, names=batch.schema.names)  # all columns may be null


def _groups(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers from 0 of the groups of equal keys that follow each other."""
    new = np.zeros(rows.num_rows, bool)
    for c in keys:
        codes = rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _painted(group: np.ndarray, x0: np.ndarray, x1: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, x0, x1, label) of the greatest label at each place of each group, in order; only stretches between ends are told apart."""
    low = x0.min()
    span = int(x1.max() - low) + 2
    a, b = group * span + x0 - low, group * span + x1 - low
    edges = np.unique(np.concatenate([a, b]))
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(edges, a[order])
    counts = np.searchsorted(edges, b[order]) - first
    at = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
    shown = np.zeros(len(edges), label.dtype)
    shown[at] = np.repeat(label[order], counts)  # of repeated places the last stays
    cuts = np.flatnonzero(np.diff(shown, prepend=0))
    kept = shown[cuts[:-1]] > 0
    starts, ends = edges[cuts[:-1]][kept], edges[cuts[1:]][kept]
    return starts // span, starts % span + low, (ends - 1) % span + low + 1, shown[cuts[:-1]][kept]


def flattened(runs: DataFrame) -> DataFrame:
    """Disjoint runs of a mask whose runs may overlap: at each place the greatest label; equal labels side by side are one run.

    The same as to_runs of the greatest label of each pixel, but no pixel is a row: a task sweeps over the sorted runs of its
    image rows, and only runs that later ones may still change are held.
    """
    keys = [*images(runs), "mask_id", "y"]
    kinds = dict(runs.dtypes)
    numbers = {c: F.col(c).cast("long").alias(c) for c in ("x0", "x1", "label")}
    own = runs.where("x1 > x0 and label > 0").select(*keys, *numbers.values()).repartition(*keys).sortWithinPartitions(*keys, "x0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in _chunks(batches):
            if held is not None:
                rows = pa.concat_tables([held, rows])
            group = _groups(rows, keys)
            g, x0, x1, label = _painted(group, *(rows[c].to_numpy() for c in ("x0", "x1", "label")))
            out = rows.select(keys).take(pa.array(np.searchsorted(group, g)))
            for c, values in (("x0", x0), ("x1", x1), ("label", label)):
                out = out.append_column(c, pa.array(values, pa.int64()))
            later = (g == group[-1]) & (x1 >= rows["x0"][-1].as_py())
            held = out.filter(pa.array(later))
            yield from out.filter(pa.array(~later)).to_batches()
        if held is not None:
            yield from held.to_batches()

    return own.mapInArrow(run, own.schema).select(*keys, *(F.col(c).cast(kinds[c]).alias(c) for c in numbers))


def areas(runs: DataFrame) -> DataFrame:
    return runs.where("label > 0").groupBy(*images(runs), "mask_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area_px"))


def filter_size(runs: DataFrame, min_size: int = 10, max_size: int = 1000) -> DataFrame:
    """Runs of the cells whose area lies in the range, both ends included; ids stay."""
    keys = [*images(runs), "mask_id", "label"]
    keep = areas(runs).where(F.col("area_px").between(min_size, max_size)).select(*keys)
    return runs.join(keep, keys, "left_semi").select(*runs.columns)


def remap_labels(runs: DataFrame, mapping: DataFrame, default: int = 0) -> DataFrame:
    """Labels by a (label, new_label) table; those it lacks become `default`. Background runs go."""
    keys = [*images(runs, mapping), "label"]
    out = runs.join(mapping.select(*keys, "new_label"), keys, "left").withColumn("label", F.coalesce("new_label", F.lit(default)))
    return out.where("label > 0").select(*runs.columns)


def mask_of(runs: DataFrame, cell_ids: DataFrame, label: int = 1) -> DataFrame:
    """The binary mask of some cells."""
    keys = images(runs, cell_ids)
    own = cell_ids.select(*keys, F.col("cell_id").alias("label"))
    return runs.join(own, [*keys, "label"], "left_semi").select(*images(runs), "mask_id", "y", "x0", "x1", F.lit(label).alias("label"))


def _strips(runs: DataFrame, prefix: str) -> DataFrame:
    cut = F.sequence(F.floor(F.col("x0") / STRIP), F.floor((F.col("x1") - 1) / STRIP))
    named = runs.where("x1 > x0 and label > 0").withColumn("strip", F.explode(cut))
    return named.select(*images(runs), "y", "strip", *(F.col(c).alias(f"{prefix}_{c}") for c in ("mask_id", "label", "x0", "x1")))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_mask, a, b_mask, b, pixels): shared pixels of cells, an interval join on equal rows and column strips."""
    keys = images(left, right)
    joined = _strips(left, "l").join(_strips(right, "r").select(*keys, "y", "strip", "r_mask_id", "r_label", "r_x0", "r_x1"), [*keys, "y", "strip"]).where("l_x0 < r_x1 and r_x0 < l_x1")
    shared = F.least("l_x1", "r_x1", (F.col("strip") + 1) * STRIP) - F.greatest("l_x0", "r_x0", F.col("strip") * STRIP)
    pairs = joined.withColumn("n", shared).where("n > 0")
    return pairs.groupBy(*images(left), F.col("l_mask_id").alias("a_mask"), F.col("l_label").alias("a"), F.col("r_mask_id").alias("b_mask"), F.col("r_label").alias("b")).agg(F.sum("n").cast("long").alias("pixels"))


def cells_in_mask(runs: DataFrame, type_runs: DataFrame, frac: float = 0.5) -> DataFrame:
    """(mask_id, cell_id, coverage): cells that a binary mask covers to a share of `frac` or more; any pixel for 0."""
    keys = images(runs)
    covered = overlaps(runs, type_runs.withColumn("label", F.lit(1))).groupBy(*keys, F.col("a_mask").alias("mask_id"), F.col("a").alias("label")).agg(F.sum("pixels").alias("pixels"))
    share = F.col("pixels") / F.col("area_px")
    out = areas(runs).join(covered, [*keys, "mask_id", "label"]).withColumn("coverage", share)
    return out.where(F.col("coverage") >= frac).select(*keys, "mask_id", F.col("label").alias("cell_id"), "coverage")


def offsets(runs: DataFrame, order: DataFrame) -> DataFrame:
    """(mask_id, ord, id_offset): the sum of the largest labels of the masks before; order: (mask_id, ord)."""
    keys = images(runs)
    masks = runs.select(*keys).distinct().crossJoin(F.broadcast(order)) if keys else order  # a few masks
    tops = masks.join(runs.groupBy(*keys, "mask_id").agg(F.max("label").alias("top")), [*keys, "mask_id"], "left")
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # one row a mask
    return tops.select(*keys, "mask_id", "ord", F.coalesce(F.sum(F.coalesce("top", F.lit(0))).over(before), F.lit(0)).cast("long").alias("id_offset"))


def merge_masks(runs: DataFrame, order: DataFrame) -> DataFrame:
    """Masks stacked in order: a later mask evicts every earlier cell that it touches, whole; ids are offset.

    A cell stays if no later mask has foreground on it: eviction is whole, so order doesn't feed back.
    """
    keys = images(runs)
    placed = runs.join(F.broadcast(order), "mask_id")  # one row a mask
    later = F.broadcast(order.select(F.col("mask_id").alias("b_mask"), F.col("ord").alias("b_ord")))
    touched = overlaps(placed, placed).where("a_mask <> b_mask").join(later, "b_mask").join(F.broadcast(order.select(F.col("mask_id").alias("a_mask"), "ord")), "a_mask")
    evicted = touched.where("b_ord > ord").select(*keys, F.col("a_mask").alias("mask_id"), F.col("a").alias("label")).distinct()
    kept = placed.where("label > 0").join(evicted, [*keys, "mask_id", "label"], "left_anti")
    shifted = kept.join(offsets(runs, order).drop("ord"), [*keys, "mask_id"])  # one row a mask
    return shifted.select(*keys, "mask_id", "y", "x0", "x1", (F.col("label") + F.col("id_offset")).alias("label"))


def cut_by(runs: DataFrame, blockers: DataFrame) -> DataFrame:
    """What of each run the blockers leave: interval subtraction row by row. Equal runs are runs of their own.

    The blockers are made disjoint; a task then sweeps over runs and blockers of its image rows together, in order. What is
    left of a run before the sweep is given out, and only what lies after it is held.
    """
    same, own = images(runs, blockers), images(runs)
    keys = [*same, "y"]
    columns = [*own, "mask_id", "y", "x0", "x1", "label"]
    blocked = blockers.where("x1 > x0").select(*same, F.lit("").alias("mask_id"), "y", "x0", "x1", F.lit(1).alias("label")).dropna(subset=keys)
    ends = [F.col(c).cast("long").alias(c) for c in ("x0", "x1")]
    rows = runs.select(*own, "mask_id", "y", *ends, "label", F.lit(1).alias("kind"))
    both = rows.unionByName(flattened(blocked).select(*keys, *ends, F.lit(0).alias("kind")), allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "x0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for some in _chunks(batches):
            at = some["x0"][-1].as_py()
            if held is not None:
                some = pa.concat_tables([held, some])
            group, kind = _groups(some, keys), some["kind"].to_numpy()
            x0, x1 = some["x0"].to_numpy(), some["x1"].to_numpy()
            low = x0.min()
            base = group * (int(max(x0.max(), x1.max()) - low) + 2) - low
            asked, walls = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            a, b = (base + x0)[asked], (base + x1)[asked]
            w0, w1 = (base + x0)[walls], (base + x1)[walls]
            first = np.searchsorted(w1, a, "right")
            met = np.maximum(np.searchsorted(w0, b, "left") - first, 0)
            of = np.repeat(np.arange(len(asked)), met + 1)
            k = np.arange(len(of)) - np.repeat(np.cumsum(met + 1) - met - 1, met + 1)
            ahead, behind = np.append(w0, 0), np.append(w1, 0)
            start = np.where(k == 0, a[of], behind[first[of] + k - 1])
            end = np.where(k == met[of], b[of], ahead[np.minimum(first[of] + k, len(w0))])
            open_ = (k == met[of]) & (group[asked] == group[-1])[of] & (x1[asked] > at)[of]
            kept = (end > start) | ((b <= a) & (met == 0))[of]
            out = some.take(pa.array(asked[of]))
            shift = base[asked[of]]
            for c, values in (("x0", start - shift), ("x1", end - shift)):
                out = out.set_column(out.schema.get_field_index(c), c, pa.array(values))
            last = walls[-1:][(group[walls[-1:]] == group[-1]) & (x1[walls[-1:]] > at)]
            held = pa.concat_tables([some.take(pa.array(last)), out.filter(pa.array(kept & open_))])
            yield from out.filter(pa.array(kept & ~open_)).select(columns).to_batches()
        if held is not None:
            yield from held.filter(pa.array(held["kind"].to_numpy() == 1)).select(columns).to_batches()

    return both.mapInArrow(run, both.select(*columns).schema)


def replace_in_region(old: DataFrame, new: DataFrame, box: tuple[int, int, int, int] | None = None, inside: DataFrame | None = None) -> DataFrame:
    """New cells put in place of old ones.

    box (y0, x0, y1, x1): old cells that lie in it and don't touch its edge go, new pixels win. inside, a table of the old
    cell_ids whose centroid is in a polygon: those go, new pixels win. Neither: new pixels only go where nothing is. New
    ids follow the largest old one.
    """
    if box is not None:
        y0, x0, y1, x1 = box
        gone = old.where("label > 0").groupBy("label").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min("x0").alias("c"), F.max("x1").alias("d")).where((F.col("a") > y0) & (F.col("b") < y1 - 1) & (F.col("c") > x0) & (F.col("d") < x1)).select("label")
    elif inside is not None:
        gone = inside.select(F.col("cell_id").alias("label"))
    else:
        gone = None
    kept = old if gone is None else old.join(gone, "label", "left_anti").select(*old.columns)
    top = F.broadcast(old.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top")))  # one row
    added = new.where("label > 0").crossJoin(top).withColumn("label", F.col("label") + F.col("_top")).drop("_top").select("mask_id", "y", "x0", "x1", "label")
    if gone is None:
        return kept.select("mask_id", "y", "x0", "x1", "label").unionByName(cut_by(added, kept))
    return cut_by(kept, added).unionByName(added)


def rasterize(regions: DataFrame, height: int, width: int) -> DataFrame:
    """Polygons (region_id, ord, ring) as label runs on an image, pixel centres inside by the even-odd rule.

    Ids are 1 to n by ord; a later polygon overwrites earlier ones. Each edge is spread over the pixel rows it crosses;
    crossings of a row are paired in order.
    """
    ordered = regions.withColumn("label", F.col("ord") + 1)
    n = F.size("ring")
    edges = ordered.select("label", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("ring", k).alias("p"), F.get("ring", (k + 1) % n).alias("q")))).alias("e"))
    edges = edges.select("label", F.col("e.p.x").alias("xa"), F.col("e.p.y").alias("ya"), F.col("e.q.x").alias("xb"), F.col("e.q.y").alias("yb")).where("ya <> yb")
    first, last = F.ceil(F.greatest(F.least("ya", "yb"), F.lit(0.0))), F.least(F.ceil(F.greatest("ya", "yb")) - 1, F.lit(height - 1))
    rows = edges.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    crossing = F.col("xa") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0.0))
    rows = rows.withColumn("x", crossing)
    w = Window.partitionBy("label", "y").orderBy("x")
    pairs = rows.withColumns({"_k": F.row_number().over(w), "_next": F.lead("x").over(w)}).where("_k % 2 = 1 and _next is not null")
    x0, x1 = F.greatest(F.ceil("x"), F.lit(0)), F.least(F.floor("_next") + 1, F.lit(width))
    runs = pairs.select(F.lit("regions").alias("mask_id"), F.col("y").cast("int").alias("y"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"), "label").where("x1 > x0")
    return flattened(runs)


def windowed(runs: DataFrame, nsize: int) -> DataFrame:
    """Runs cut at the edges of square windows: adds wy, wx."""
    cut = runs.where("x1 > x0 and label > 0").withColumn("wx", F.explode(F.sequence(F.floor(F.col("x0") / nsize), F.floor((F.col("x1") - 1) / nsize))))
    return cut.select(*images(runs), "mask_id", "y", F.greatest("x0", F.col("wx") * nsize).alias("x0"), F.least("x1", (F.col("wx") + 1) * nsize).alias("x1"), "label", F.floor(F.col("y") / nsize).alias("wy"), "wx")


def window_stats(runs: DataFrame, nsize: int = 40) -> DataFrame:
    """Per window and mask: labels, median area of their parts, and evenness 1 / (ln(sd / sqrt(n)) + 1), 0 where undefined."""
    return stats_of_cuts(windowed(runs, nsize), [*images(runs), "wy", "wx"])


def stats_of_cuts(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The same for runs that are cut to windows of any kind, told apart by keys."""
    parts = cut.groupBy(*keys, "mask_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    out = parts.groupBy(*keys, "mask_id").agg((F.count("*") + 1).alias("n_labels"), F.percentile("area", 0.5).alias("median_area"), F.stddev_pop("area").alias("_sd"), F.count("*").alias("_n"))
    spread = F.col("_sd") / F.sqrt("_n")
    bottom = F.when(spread > 0, F.ln(spread) + 1)
    return out.withColumn("evenness", F.coalesce(F.when(bottom != 0, 1 / F.nullif(bottom, F.lit(0.0))), F.lit(0.0))).drop("_sd", "_n")


def window_jaccard(runs: DataFrame, nsize: int = 40) -> DataFrame:
    """Per window and pair of masks (a_mask < b_mask): shared and joint foreground, and their ratio."""
    return jaccard_of_cuts(windowed(runs, nsize), [*images(runs), "wy", "wx"])


def jaccard_of_cuts(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The same for runs that are cut to windows of any kind, told apart by keys."""
    size = cut.groupBy(*keys, "mask_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    a = cut.select(*keys, "y", F.col("mask_id").alias("a_mask"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = cut.select(*keys, "y", F.col("mask_id").alias("b_mask"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    met = a.join(b, [*keys, "y"]).where("a_mask < b_mask and a0 < b1 and b0 < a1").groupBy(*keys, "a_mask", "b_mask").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))
    pairs = size.toDF(*keys, "a_mask", "a_n").join(size.toDF(*keys, "b_mask", "b_n"), keys).where("a_mask < b_mask")
    out = pairs.join(met, [*keys, "a_mask", "b_mask"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    joint = F.col("a_n") + F.col("b_n") - F.col("shared")
    return out.select(*keys, "a_mask", "b_mask", "shared", joint.alias("joint"), (F.col("shared") / joint).alias("jaccard"))


def window_winner(stats: DataFrame, jaccard: DataFrame | None, order: DataFrame, merit: str = "pop") -> DataFrame:
    """(wy, wx, mask_id): the best mask of each window; ties go to the first by order.

    pop: most labels. cstd: greatest evenness. j1: the mask with the least summed Jaccard is left out; of the others the one
    with the greatest sum wins if that exceeds its agreement with itself, 1; else the first mask without any sum wins.
    """
    if merit == "j1":
        return jaccard_winner(stats, jaccard, order, [*images(stats), "wy", "wx"])
    scored = stats.withColumn("score", F.col({"pop": "n_labels", "cstd": "evenness"}[merit]).cast("double"))
    placed = scored.join(F.broadcast(order), "mask_id")
    keys = [*images(stats), "wy", "wx"]
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return placed.withColumn("_k", best).where("_k = 1").select(*keys, "mask_id", "score")


def jaccard_winner(stats: DataFrame, jaccard: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    grid = stats.select(*keys).distinct().crossJoin(F.broadcast(order.select("mask_id", "ord")))  # a few masks
    own = stats.select(*keys, "mask_id", F.lit(1.0).alias("self"))
    both = jaccard.select(*keys, F.col("a_mask").alias("mask_id"), F.col("b_mask").alias("other"), "jaccard")
    both = both.unionByName(jaccard.select(*keys, F.col("b_mask").alias("mask_id"), F.col("a_mask").alias("other"), "jaccard"))
    sums = both.groupBy(*keys, "mask_id").agg(F.sum("jaccard").alias("s"))
    scored = grid.join(own, [*keys, "mask_id"], "left").join(sums, [*keys, "mask_id"], "left")
    scored = scored.withColumn("sum", F.coalesce("self", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)))
    worst = scored.groupBy(*keys).agg(F.min_by("mask_id", F.struct("sum", "ord")).alias("worst"))
    rest = both.join(worst, keys).where("other <> worst").groupBy(*keys, "mask_id").agg(F.sum("jaccard").alias("rest"))  # anew: a difference of sums isn't exact
    after = scored.join(worst, keys).join(rest, [*keys, "mask_id"], "left")
    after = after.withColumn("score", F.when(F.col("mask_id") == F.col("worst"), 0.0).otherwise(F.coalesce("self", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))))
    top = Window.partitionBy(*keys)
    agreed = F.max("score").over(top) > 1.0
    place = F.row_number().over(top.orderBy(F.when(F.col("_agreed"), -F.col("score")).otherwise(F.col("score")), "ord"))
    return after.withColumn("_agreed", agreed).withColumn("_k", place).where("_k = 1").select(*keys, "mask_id", "score")


def near_cells(cells: DataFrame, within_masks: bool = False, left: list[str] | None = None, right: list[str] | None = None) -> DataFrame:
    """(a_mask, a, b_mask, b): cells of different masks whose centres are within sqrt(area / pi) of the first on both axes: a grid join.

    within_masks: those of one mask too, and each cell with itself. left, right: columns of the first and the second cell to
    return as a_... and b_... in place of the four. The grid of a cell is as coarse as its reach, by powers of two, so it meets
    two places at most on each axis; every cell is placed once on each grid in use.
    """
    keys = images(cells)
    r = F.sqrt(F.col("area_px") / F.lit(3.141592653589793))
    level = F.greatest(F.ceil(F.log2(r * 2)), F.lit(0)).cast("int")
    ask = cells.where("area_px > 0").select(*keys, F.struct("*").alias("p"), r.alias("r"), level.alias("level"))
    levels = ask.select("level").distinct()  # a few: by powers of two
    edge = F.pow(F.lit(2.0), F.col("level"))
    named = {"a_mask": "p.mask_id", "a": "p.cell_id", "b_mask": "q.mask_id", "b": "q.cell_id"}
    if left is not None or right is not None:
        named = {f"a_{c}": f"p.{c}" for c in left or []} | {f"b_{c}": f"q.{c}" for c in right or []}
    held = {t: sorted({v.split(".")[1] for v in named.values() if v.startswith(t)} | {"mask_id", "x_px", "y_px"}) for t in "pq"}
    ask = ask.withColumn("p", F.struct(*(F.col(f"p.{c}").alias(c) for c in held["p"])))
    for axis, at in (("gx", "p.x_px"), ("gy", "p.y_px")):
        ask = ask.withColumn(axis, F.explode(F.sequence(F.floor((F.col(at) - F.col("r")) / edge), F.floor((F.col(at) + F.col("r")) / edge))))
    met = cells.select(*keys, F.struct(*held["q"]).alias("q")).crossJoin(F.broadcast(levels))
    met = met.withColumns({"gx": F.floor(F.col("q.x_px") / edge), "gy": F.floor(F.col("q.y_px") / edge)})
    near = ask.join(met, [*keys, "level", "gx", "gy"]).where("abs(p.x_px - q.x_px) < r and abs(p.y_px - q.y_px) < r")
    if not within_masks:
        near = near.where("p.mask_id <> q.mask_id")
    return near.select(*keys, *(F.col(v).alias(c) for c, v in named.items()))
