"""Automatic thresholds per marker over the positive cell means, from the published definitions.

Otsu, Yen, IsoData and Triangle read a histogram of 256 equal bins between the least and largest value of a marker; all
markers are handled in the same aggregations and windows, 256 rows each. Li iterates on the raw values, sorted once. A marker needs two values or more, else it has no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoframe.operators.ranks import sorted_counts
from histoframe.scratch import Scratch

BINS = 256


def positive_means(cell_marker: DataFrame) -> DataFrame:
    """(marker, v): the means above zero of markers that have more than one."""
    v = cell_marker.where("mean > 0").select("marker", F.col("mean").alias("v"))
    enough = v.groupBy("marker").agg(F.count("*").alias("n")).where("n > 1").select("marker")
    return v.join(enough, "marker", "left_semi")


def histogram(values: DataFrame) -> DataFrame:
    """(marker, lo, hi, bin, h, c) over the full grid of bins, with counts and centres."""
    ends = values.groupBy("marker").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / width * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    counts = values.join(ends, "marker").groupBy("marker", at.alias("bin")).agg(F.count("*").alias("h"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / BINS
    return grid.join(counts, ["marker", "bin"], "left").select("marker", "lo", "hi", "bin", F.coalesce("h", F.lit(0)).alias("h"), centre.alias("c"))


def _before(marker: str = "marker"):
    return Window.partitionBy(marker).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _after():
    return Window.partitionBy("marker").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)


def _first_best(scored: DataFrame, score: Column) -> DataFrame:
    """The centre of the first bin with the greatest score; the value itself for markers with one distinct value."""
    best = F.max_by(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("c")), F.struct(F.col("_s"), -F.col("bin")))
    return scored.withColumn("_s", F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(score)).where("_s is not null").groupBy("marker").agg(best.alias("threshold"))


def otsu(cell_marker: DataFrame) -> DataFrame:
    return otsu_of(histogram(positive_means(cell_marker)))


def otsu_of(h: DataFrame) -> DataFrame:
    """(marker, threshold) from a histogram (marker, lo, hi, bin, h, c)."""
    h = h.withColumns({"w1": F.sum("h").over(_before()), "s1": F.sum(F.col("h") * F.col("c")).over(_before()), "w2": F.sum("h").over(_after()), "s2": F.sum(F.col("h") * F.col("c")).over(_after())})
    gap = F.col("s1") / F.nullif("w1", F.lit(0)) - F.col("s2") / F.nullif("w2", F.lit(0))
    return _first_best(h, F.col("w1") * F.col("w2") * gap * gap)


def yen(cell_marker: DataFrame) -> DataFrame:
    h = histogram(positive_means(cell_marker))
    p = F.col("h") / F.sum("h").over(Window.partitionBy("marker"))
    h = h.withColumn("p", p).withColumns({"p1": F.sum("p").over(_before()), "q1": F.sum(F.col("p") * F.col("p")).over(_before()), "q2": F.sum(F.col("p") * F.col("p")).over(_after())})
    mass = F.col("p1") * (1 - F.col("p1"))
    both = F.col("q1") * F.col("q2")
    return _first_best(h, F.when((both > 0) & (mass > 0), F.ln(mass * mass / F.nullif(both, F.lit(0.0)))))


def isodata(cell_marker: DataFrame) -> DataFrame:
    h = histogram(positive_means(cell_marker))
    h = h.withColumns({"w1": F.sum("h").over(_before()), "s1": F.sum(F.col("h") * F.col("c")).over(_before()), "w2": F.sum("h").over(_after()), "s2": F.sum(F.col("h") * F.col("c")).over(_after())})
    middle = (F.col("s1") / F.nullif("w1", F.lit(0)) + F.col("s2") / F.nullif("w2", F.lit(0))) / 2 - F.col("c")
    width = (F.col("hi") - F.col("lo")) / BINS
    flat = F.col("lo") == F.col("hi")
    fits = h.where(flat | ((middle >= 0) & (middle < width)))
    return fits.groupBy("marker").agg(F.min(F.when(flat, F.col("lo")).otherwise(F.col("c"))).alias("threshold"))


def triangle(cell_marker: DataFrame) -> DataFrame:
    h = histogram(positive_means(cell_marker))
    ends = h.groupBy("marker").agg(
        F.max_by(F.struct("bin", "h"), F.struct("h", -F.col("bin"))).alias("peak"), F.min(F.when(F.col("h") > 0, F.col("bin"))).alias("first"), F.max(F.when(F.col("h") > 0, F.col("bin"))).alias("last")
    )
    left = F.col("peak.bin") - F.col("first") >= F.col("last") - F.col("peak.bin")
    ends = ends.select("marker", F.col("peak.bin").alias("top"), F.col("peak.h").alias("height"), F.when(left, F.col("first")).otherwise(F.col("last")).alias("end"))
    span = F.abs(F.col("top") - F.col("end"))
    away = F.abs(F.col("bin") - F.col("end"))
    inside = (F.col("bin") != F.col("top")) & F.col("bin").between(F.least("top", "end"), F.greatest("top", "end"))
    scored = h.join(F.broadcast(ends), "marker").where(inside | (F.col("lo") == F.col("hi")))  # one row a marker
    distance = F.col("height") * away - span * F.col("h")
    best = F.max_by(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("c")), F.struct(distance.alias("d"), -away))
    return scored.groupBy("marker").agg(best.alias("threshold"))


LI_BLOCK = 4096  # distinct values of a marker, sorted, whose totals are one row


def li(cell_marker: DataFrame) -> DataFrame:
    """Iterative minimum cross entropy, over sorted values with the totals of blocks of LI_BLOCK.

    A round needs the sums above and below a threshold: those of whole blocks come from their totals, which the driver has (a
    row a block), and the one block that the threshold cuts is read by its place. No round goes over all values, and rounds
    go on until a marker's threshold moves by half its smallest gap or less.
    """
    spark = cell_marker.sparkSession
    scratch = Scratch(spark, "li")
    values = scratch.table(positive_means(cell_marker), "values")
    place = Window.partitionBy("marker", "_part").orderBy("v")
    block = F.floor((F.row_number().over(place) - 1) / LI_BLOCK)
    ends = scratch.table(values.groupBy("marker").agg(F.min("v").alias("lo"), F.avg("v").alias("mean")), "ends")
    rows = sorted_counts(values, "marker", "v", scratch).join(ends.select("marker", "lo"), "marker")
    rows = rows.withColumns({"block": block, "gap": F.col("v") - F.lag("v").over(place), "off": F.col("v") - F.col("lo")})
    rows = scratch.table(rows.select("marker", "_part", "block", "v", "c", "off", "gap"), "blocks")
    totals: dict[str, list] = {}
    for r in rows.groupBy("marker", "_part", "block").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("off")).alias("s"), F.min("off").alias("a"), F.max("off").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("gap").alias("gap")).orderBy("_part", "block").collect():
        totals.setdefault(r.marker, []).append(r)
    state = {}
    for r in ends.collect():  # a row a marker
        some = totals[r.marker]
        gaps = [x.gap for x in some if x.gap is not None] + [y.lo - x.hi for x, y in zip(some, some[1:])]
        state[r.marker] = [r.lo, r["mean"] - r.lo, min(gaps, default=0.0) / 2, False]
    cut: dict[tuple, list] = {}
    while asked := [m for m, x in state.items() if not x[3]]:
        missing = [(m, x["_part"], x.block) for m in asked for x in totals[m] if x.a <= state[m][1] < x.b and (m, x["_part"], x.block) not in cut]
        if missing:  # a block a marker at most
            wanted = F.lit(False)
            for m, part, number in missing:
                wanted |= (F.col("marker") == m) & (F.col("_part") == part) & (F.col("block") == number)
                cut[m, part, number] = []
            for r in rows.where(wanted).select("marker", "_part", "block", "off", "c").collect():
                cut[r.marker, r["_part"], r.block].append((r.off, r.c))
        for m in asked:
            lo, t, tolerance, _ = state[m]
            over, under = [0, 0.0], [0, 0.0]
            for x in totals[m]:
                parts = [(x.a > t, x.n, x.s)] if x.a > t or x.b <= t else [(off > t, c, off * c) for off, c in cut[m, x["_part"], x.block]]
                for above, n, s in parts:
                    side = over if above else under
                    side[0] += n
                    side[1] += s
            fore, back = over[1] / over[0] if over[0] else None, under[1] / under[0] if under[0] else None
            if not fore or not back or fore == back:
                state[m][3] = True
                continue
            after = (back - fore) / (math.log(back) - math.log(fore))
            state[m] = [lo, after, tolerance, abs(after - t) <= tolerance]
    return spark.createDataFrame([(m, lo + t) for m, (lo, t, _, _) in state.items()], "marker string, threshold double")


METHODS = {"otsu": otsu, "triangle": triangle, "li": li, "yen": yen, "isodata": isodata}


def thresholds(cell_marker: DataFrame, method: str = "otsu", manual: DataFrame | None = None) -> DataFrame:
    """(marker, method, threshold); a manual (marker, threshold) takes the place of the automatic one."""
    found = METHODS[method](cell_marker).withColumn("method", F.lit(method))
    if manual is not None:
        own = manual.select("marker", F.col("threshold").alias("_own"))
        found = found.join(F.broadcast(own), "marker", "full").select("marker", F.when(F.col("_own").isNotNull(), "manual").otherwise(F.col("method")).alias("method"), F.coalesce("_own", "threshold").alias("threshold"))
    return found.select("marker", "method", "threshold")
