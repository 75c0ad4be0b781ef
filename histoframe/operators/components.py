"""Connected components of a table of links, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, itself included; from links (a, b).

    Alternating large-star and small-star rounds. A node with very many links is only ever reduced to a minimum, with
    map-side combining, or joined as one row to its links, which adaptive execution splits. Every round is a written
    table, so a lost executor costs no earlier round. Self-links and repeated links are harmless.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = scratch.table(links.where("a <> b").select(a, b).distinct(), f"{label}-0")
    state, k = None, 0
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == state or not found.n:
            break
        state = (found.n, found.h)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large, f"{label}-{k}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = scratch.table(small.where("a <> b").distinct(), f"{label}-{k + 1}")
        scratch.drop(f"{label}-{k}", f"{label}-{k}-large")
        now, k = after, k + 1
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
