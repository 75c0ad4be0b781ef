"""Cells in drawn regions, and what their cell types say about the regions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoframe.functions.columns import bounding_box, in_ring, share

OUTSIDE = "outside"
NAN, INF = float("nan"), float("inf")


def grid_join(points: DataFrame, boxes: DataFrame, edge: float = 128.0) -> DataFrame:
    """Points (x, y) with the boxes (box: struct x0, y0, x1, y1) that hold them: an equi join on grid cells, then the box.

    A box is spread over the grid cells that it covers; a point has one cell. So no nested loop is planned.
    """
    spread = boxes
    for axis, a, b in (("gx", "x0", "x1"), ("gy", "y0", "y1")):
        spread = spread.withColumn(axis, F.explode(F.sequence(F.floor(F.col(f"box.{a}") / edge), F.floor(F.col(f"box.{b}") / edge))))
    placed = points.withColumns({"gx": F.floor(F.col("x") / edge), "gy": F.floor(F.col("y") / edge)})
    inside = F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1"))
    return placed.join(spread, ["gx", "gy"]).where(inside).drop("gx", "gy")


def cells_in_regions(cells: DataFrame, regions: DataFrame, rule: str = "exact") -> DataFrame:
    """(cell_id, region, ord), a row for every region that holds a cell's centroid.

    exact: the float centroid by the even-odd rule. raster: the centroid cut to whole pixels, against pixel centres.
    regions: (region, ord, ring).
    """
    x, y = F.col("x_px"), F.col("y_px")
    if rule == "raster":
        x, y = F.floor(x).cast("double"), F.floor(y).cast("double")
    points = cells.select("cell_id", x.alias("x"), y.alias("y"))
    found = grid_join(points, regions.select("region", "ord", "ring", bounding_box(F.col("ring")).alias("box")))
    return found.where(in_ring(F.col("ring"), F.col("x"), F.col("y"))).select("cell_id", "region", "ord").distinct()


def assign_regions(cells: DataFrame, regions: DataFrame, rule: str = "exact") -> DataFrame:
    """(cell_id, region, ambiguous): the first region by ord that holds a cell, `outside` without one."""
    first = cells_in_regions(cells, regions, rule).groupBy("cell_id").agg(F.min_by("region", "ord").alias("region"), (F.count_distinct("region") > 1).alias("ambiguous"))
    return cells.select("cell_id").join(first, "cell_id", "left").select("cell_id", F.coalesce("region", F.lit(OUTSIDE)).alias("region"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def cells_per_region(region_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct cells per region, a line for all assigned cells, and a line for the unassigned; with percent of all cells.

    A cell in two regions counts in both, and once among the assigned.
    """
    total = F.broadcast(cells.agg(F.count_distinct("cell_id").alias("n_all")))  # one row
    lines = region_cells.rollup("region").agg(F.count_distinct("cell_id").alias("n_cells"), F.grouping("region").alias("g"))
    lines = lines.select(F.when(F.col("g") == 1, "assigned").otherwise(F.col("region")).alias("region"), "n_cells")
    rest = cells.select("cell_id").join(region_cells.select("cell_id"), "cell_id", "left_anti").agg(F.count_distinct("cell_id").alias("n_cells")).select(F.lit("unassigned").alias("region"), "n_cells")
    both = lines.unionByName(rest).crossJoin(total)
    return both.select("region", "n_cells", (100 * share(F.col("n_cells"), F.col("n_all"))).alias("percent"))


def region_counts(typed: DataFrame, regions: list[str], totals: DataFrame | None = None) -> DataFrame:
    """Per cell type: cells in each region of the list, their percent of the region's cells, outside, and in all.

    typed: (cell_id, cell_type, region), several types a cell if gating gave them. totals: (region, n); counted from the
    distinct cells of `typed` if not given. The percent of an empty region is NaN.
    """
    sizes = totals if totals is not None else typed.groupBy("region").agg(F.count_distinct("cell_id").alias("n"))
    wide = sizes.agg(*(F.coalesce(F.max(F.when(F.col("region") == r, F.col("n"))), F.lit(0)).alias(f"_n_{r}") for r in regions))  # one row
    counts = typed.groupBy("cell_type").agg(*(F.count_if(F.col("region") == r).alias(f"n_{r}") for r in regions), F.count_if(~F.col("region").isin(regions)).alias("n_outside"), F.count("*").alias("n_total"))
    both = counts.crossJoin(F.broadcast(wide))
    percents = [(100 * share(F.col(f"n_{r}"), F.col(f"_n_{r}"))).alias(f"percent_{r}") for r in regions]
    return both.select("cell_type", *(f"n_{r}" for r in regions), *percents, "n_outside", "n_total")


def _two(typed: DataFrame, cells: DataFrame, a: str, b: str) -> DataFrame:
    """Per type: cells of it and of all kinds in regions a and b. cells: (cell_id, region), one row a cell."""
    sizes = cells.agg(F.count_if(F.col("region") == a).alias("n_a"), F.count_if(F.col("region") == b).alias("n_b"))  # one row
    counts = typed.groupBy("cell_type").agg(F.count_if(F.col("region") == a).alias("in_a"), F.count_if(F.col("region") == b).alias("in_b"))
    return counts.crossJoin(F.broadcast(sizes))


def fisher(typed: DataFrame, cells: DataFrame, a: str, b: str) -> DataFrame:
    """Fisher separation of two regions by each type: (pA - pB)^2 / (pA (1 - pA) + pB (1 - pB)).

    NaN with an empty region; 0 / 0 is 0; x / 0 is infinite.
    """
    p, q = share(F.col("in_a"), F.col("n_a")), share(F.col("in_b"), F.col("n_b"))
    both = _two(typed, cells, a, b).withColumns({"p_a": p, "p_b": q})
    gap = (F.col("p_a") - F.col("p_b")) * (F.col("p_a") - F.col("p_b"))
    spread = F.col("p_a") * (1 - F.col("p_a")) + F.col("p_b") * (1 - F.col("p_b"))
    j = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), F.lit(NAN)).when((spread == 0) & (gap == 0), F.lit(0.0)).when(spread == 0, F.lit(INF)).otherwise(gap / F.nullif(spread, F.lit(0.0)))
    return both.select("cell_type", "in_a", "n_a", "in_b", "n_b", "p_a", "p_b", j.alias("separation"))


def separation_summary(scored: DataFrame, drop: tuple[str, ...] = ("Unknown",), key: str = "method") -> DataFrame:
    """Mean and median of finite separations and the number of infinite ones, by method; named types are left out."""
    finite = F.when(F.col("separation") < INF, F.col("separation"))
    kept = scored.where(~F.col("cell_type").isin(*drop) & ~F.isnan("separation"))
    return kept.groupBy(key).agg(F.avg(finite).alias("mean"), F.percentile(finite, 0.5).alias("median"), F.count_if(F.col("separation") == INF).alias("n_infinite"), F.count("*").alias("n_types"))


def better_method(scored: DataFrame, key: str = "method") -> DataFrame:
    """Per type: the method with the greatest separation; ties go to the first name."""
    best = F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("separation"), key))
    return scored.where(~F.isnan("separation")).withColumn("_k", best).where("_k = 1").select("cell_type", key, "separation")


def odds_ratio(a: Column, all_a: Column, b: Column, all_b: Column) -> Column:
    """a (B - b) / ((A - a) b) without correction: infinite if only the bottom is zero, NaN if both are."""
    top, bottom = (a * (all_b - b)).cast("double"), ((all_a - a) * b).cast("double")
    return F.when(bottom == 0, F.when(top > 0, INF).otherwise(NAN)).otherwise(top / F.nullif(bottom, F.lit(0.0)))


def odds_ratios(typed: DataFrame, cells: DataFrame, a: str, b: str) -> DataFrame:
    """Odds ratio of each type in region a against region b, and its log2 (-inf for 0)."""
    both = _two(typed, cells, a, b).withColumn("odds_ratio", odds_ratio(F.col("in_a"), F.col("n_a"), F.col("in_b"), F.col("n_b")))
    log = F.when(F.isnan("odds_ratio"), NAN).when(F.col("odds_ratio") == 0, -INF).when(F.col("odds_ratio") == INF, INF).otherwise(F.log2(F.nullif("odds_ratio", F.lit(0.0))))
    return both.withColumn("log2_odds_ratio", log)


def enrichment(typed: DataFrame, cells: DataFrame, positive: str, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Per type: share of its cells in the positive region over the share of all cells there; pooled over name patterns."""
    base = cells.agg(F.count("*").alias("n_all"), F.count_if(F.col("region") == positive).alias("n_positive"))  # one row
    counts = typed.groupBy("cell_type").agg(F.count("*").alias("n"), F.count_if(F.col("region") == positive).alias("n_in"))
    if patterns:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.lower("cell_type").contains(p.lower())
        pooled = typed.where(hit).agg(F.lit("pooled").alias("cell_type"), F.count("*").alias("n"), F.count_if(F.col("region") == positive).alias("n_in"))
        counts = counts.unionByName(pooled)
    both = counts.crossJoin(F.broadcast(base))
    own, baseline = share(F.col("n_in"), F.col("n")), share(F.col("n_positive"), F.col("n_all"))
    return both.select("cell_type", "n", "n_in", own.alias("share"), baseline.alias("baseline"), share(own, baseline).alias("enrichment"), (F.col("n") == 0).alias("none_found"))


def composition_distance(typed: DataFrame, a: str, b: str) -> DataFrame:
    """Total variation and Jensen-Shannon distance (base 2) between the type shares of two regions; one row."""
    counts = typed.groupBy("cell_type").agg(F.count_if(F.col("region") == a).cast("double").alias("a"), F.count_if(F.col("region") == b).cast("double").alias("b"))
    sums = F.broadcast(counts.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")))  # one row
    p, q = share(F.col("a"), F.col("sa")), share(F.col("b"), F.col("sb"))
    shares = counts.crossJoin(sums).select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / F.nullif("m", F.lit(0.0)))).otherwise(0.0) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / F.nullif("m", F.lit(0.0)))).otherwise(0.0)
    return shares.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), F.sqrt(F.greatest(F.sum(term) / 2, F.lit(0.0))).alias("jensen_shannon"))


def median_by(rows: DataFrame, keys: list[str], columns: list[str], digits: int = 3) -> DataFrame:
    """Medians by keys, rounded; NaN counts as missing."""
    return rows.groupBy(*keys).agg(*(F.round(F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None)), 0.5), digits).alias(f"median_{c}") for c in columns))


def compare_calls(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per type: cells in either of two results, the change, and whether the members are the same."""
    a = left.select("cell_id", "cell_type").distinct().withColumn("_a", F.lit(1))
    b = right.select("cell_id", "cell_type").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["cell_id", "cell_type"], "full")
    out = both.groupBy("cell_type").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same_members"))
    return out.withColumn("delta", F.col("n_right") - F.col("n_left"))


def align_types(counts: DataFrame, how: str = "union", key: str = "method", value: str = "n", seen: str | None = None) -> DataFrame:
    """A row for each type and method: all types with 0 where a method lacks one, or only types that all methods have.

    `seen`, a column of counts, is where a type was first met: each type's rows get its least value, to sort them by.
    """
    if seen is not None:
        order = counts.groupBy("cell_type").agg(F.min(seen).alias(seen))
        return align_types(counts.drop(seen), how, key, value).join(order, "cell_type")
    methods = counts.select(key).distinct()
    if how == "shared":
        n = F.broadcast(methods.agg(F.count("*").alias("_m")))  # one row
        shared = counts.where(F.col(value) > 0).groupBy("cell_type").agg(F.count_distinct(key).alias("_n")).crossJoin(n).where("_n = _m").select("cell_type")
        return counts.join(shared, "cell_type", "left_semi")
    grid = counts.select("cell_type").distinct().crossJoin(F.broadcast(methods))  # a few methods
    return grid.join(counts, ["cell_type", key], "left").fillna(0, [value])


def _clip(ring: list[tuple[float, float]], width: float, height: float) -> list[tuple[float, float]]:
    """A polygon cut to the rectangle from (0, 0): one half-plane after another."""
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        out = []
        for k, p in enumerate(ring):
            q = ring[k - 1]
            a, b = sign * (q[axis] - limit), sign * (p[axis] - limit)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if b >= 0:
                out.append(p)
        ring = out
    return ring


def _simplify(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """The fewest of the points that stay within eps of the line, by splitting at the furthest one; an explicit stack."""
    if eps <= 0 or len(points) <= 2:
        return points
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        worst, at = -1.0, None
        for k in range(a + 1, b):
            x, y = points[k]
            t = 0.0 if length2 == 0 else min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length2))
            d = ((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) ** 0.5
            if d > worst:
                worst, at = d, k
        if at is not None and worst > eps:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[k] for k in sorted(keep)]


def prepare_regions(regions: DataFrame, eps: float, width: float, height: float) -> DataFrame:
    """Rings simplified, then cut to the image and closed; rings with fewer than four points then are dropped. Adds bbox."""
    place = regions.columns.index("ring")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ring = [(p["x"], p["y"]) for p in row["ring"] or ()]
                ring = _clip(_simplify(ring, eps), width, height)
                if len(ring) >= 3:
                    row["ring"] = [{"x": x, "y": y} for x, y in [*ring, ring[0]]]
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return regions.mapInArrow(run, regions.schema).withColumn("bbox", bounding_box(F.col(regions.columns[place])))
