"""Marker states, rule-based cell types, and names for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def positivity(cell_marker: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(cell_id, marker, state): 2 where the mean reaches the marker's threshold, else 1; markers without one drop out."""
    joined = cell_marker.join(F.broadcast(thresholds.select("marker", "threshold")), "marker")  # one row a marker
    return joined.select("cell_id", "marker", F.when(F.col("mean") >= F.col("threshold"), 2).otherwise(1).alias("state"))


def gate(states: DataFrame, phenotypes: DataFrame, cells: DataFrame | None = None, unknown: bool = True) -> DataFrame:
    """(cell_id, cell_type, type_ord): every type all of whose rules a cell meets, a relational division.

    phenotypes: (type_ord, cell_type, marker, required), required 1 positive, 2 negative, anything else no rule. A marker
    that a cell lacks fails the type. Types without rules match nothing. Cells without a type are `Unknown`, after all others.
    """
    rules = phenotypes.where(F.col("required").isin(1, 2)).select("type_ord", "cell_type", "marker", F.when(F.col("required") == 1, 2).otherwise(1).alias("want"))
    sizes = rules.groupBy("type_ord", "cell_type").agg(F.count("*").alias("n_rules"))
    # The rule table is a form that people fill in: markers x types.
    met = states.join(F.broadcast(rules), "marker").where(F.col("state") == F.col("want")).groupBy("cell_id", "type_ord", "cell_type").agg(F.count("*").alias("n_met"))
    typed = met.join(F.broadcast(sizes), ["type_ord", "cell_type"]).where(F.col("n_met") == F.col("n_rules")).select("cell_id", "cell_type", "type_ord")
    if not unknown:
        return typed
    everyone = (cells if cells is not None else states).select("cell_id").distinct()
    rest = everyone.join(typed, "cell_id", "left_anti").select("cell_id", F.lit(UNKNOWN).alias("cell_type"), F.lit(2**31 - 1).alias("type_ord"))
    return typed.unionByName(rest)


def cluster_states(clusters: DataFrame, states: DataFrame, positive: float = 0.6, negative: float = 0.2) -> DataFrame:
    """(cluster_id, marker, fraction, state): the share of positive cells among those with a state.

    State 1 from `positive` up, 2 from `negative` down, 0 between or without any cell that has a state. Noise is left out.
    """
    own = clusters.where("cluster_id >= 0").join(states, "cell_id")
    valid = F.when(F.col("state") > 0, (F.col("state") == 2).cast("double"))
    out = own.groupBy("cluster_id", "marker").agg(F.avg(valid).alias("fraction"))
    return out.withColumn("state", F.when(F.col("fraction") >= positive, 1).when(F.col("fraction") <= negative, 2).otherwise(0))


def name_clusters(states: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """(cluster_id, cell_type): the first type by order whose rules all equal the cluster's states, else `Unknown`."""
    rules = phenotypes.where(F.col("required").isin(1, 2))
    sizes = rules.groupBy("type_ord", "cell_type").agg(F.count("*").alias("n_rules"))
    met = states.join(F.broadcast(rules), "marker").where(F.col("state") == F.col("required")).groupBy("cluster_id", "type_ord", "cell_type").agg(F.count("*").alias("n_met"))
    fit = met.join(F.broadcast(sizes), ["type_ord", "cell_type"]).where(F.col("n_met") == F.col("n_rules"))
    first = fit.groupBy("cluster_id").agg(F.min_by("cell_type", "type_ord").alias("cell_type"))
    return states.select("cluster_id").distinct().join(first, "cluster_id", "left").withColumn("cell_type", F.coalesce("cell_type", F.lit(UNKNOWN)))


def rename(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Rows with names replaced; names that aren't mapped stay."""
    if not mapping:
        return rows
    pairs = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return rows.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def reorder_types(phenotypes: DataFrame, order: list[str]) -> DataFrame:
    """Types renumbered by a list; those that it lacks follow in their old order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("cell_type")) if order else F.lit(0)
    return phenotypes.withColumn("type_ord", F.when(place > 0, place.cast("int") - 1).otherwise(F.col("type_ord") + len(order)))


def delete_type(phenotypes: DataFrame, name: str) -> DataFrame:
    return phenotypes.where(F.col("cell_type") != name)


def cycle_rule(phenotypes: DataFrame, cell_type: str, marker: str) -> DataFrame:
    """The rule of one type and marker moved on: blank, positive, negative, blank."""
    here = (F.col("cell_type") == cell_type) & (F.col("marker") == marker)
    return phenotypes.withColumn("required", F.when(here, (F.col("required") + 1) % 3).otherwise(F.col("required")))
