"""Queries over the star tables, which stand in for cytometry data; each has the SQL that gives the same rows.

events: pixel readings (user_id + 1 = cell, event_type = marker). lineitem: wide pixel rows of four channels (l_partkey =
cell) and label runs of two masks (l_linestatus = mask, l_suppkey = row, first column by order and line, l_quantity long,
l_orderkey = label). customer: cells at (c_custkey % 100, c_custkey div 100), their segment as type and their region as
tissue. orders: states by priority. embeddings: cells x channels with a cluster. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histoframe.functions.columns import natural_key, safe_names
from histoframe.operators import clusters as C
from histoframe.operators.fusion import fuse_masks
from histoframe.operators import gating as G
from histoframe.operators import measure as M
from histoframe.operators import normalize as N
from histoframe.operators import regions as R
from histoframe.operators import runs as L
from histoframe.operators import thresholds as T
from histoframe.operators import labels as B
from histoframe.operators import neighbors as K
from histoframe.operators import tiles as I
from histoframe.operators.neighbors import knn
from histoframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# ---- stand-ins for the data model

RULES = [(0, "buyer", "purchase", 1), (0, "buyer", "error", 2), (1, "viewer", "view", 1), (1, "viewer", "purchase", 2), (2, "noisy", "error", 1)]
#: (region, ord, points); the first and second overlap.
REGIONS = [
    ("Lesion 1", 0, [(5.5, 0.5), (60.5, 0.5), (60.5, 70.5), (30.5, 20.5), (5.5, 70.5)]),
    ("Lung 1", 1, [(40.5, 0.5), (95.5, 2.5), (90.5, 120.5), (45.5, 90.5)]),
    ("Lung 2", 2, [(2.5, 80.5), (35.5, 75.5), (20.5, 140.5)]),
]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("cell_id"), F.col("event_type").alias("marker"), "value")


def cell_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_means(pixels(spark, sf_dir))


def phenotypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "type_ord int, cell_type string, marker string, required int")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a run: its supplier's row, its order's place, its order's label; runs of a row may overlap."""
    x0 = (F.col("l_orderkey") % 512 * 16 + F.col("l_linenumber")).cast("long")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_linestatus").alias("mask_id"), F.col("l_suppkey").alias("y"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"), (F.col("l_orderkey") + 1).alias("label"))


def mask_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F", 0), ("O", 1)], "mask_id string, ord int")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, x_px, y_px, cell_type, region) from customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    cells = table(spark, sf_dir, "customer").join(F.broadcast(places), "c_nationkey")  # 25 nations
    return cells.select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 100).cast("double").alias("x_px"), F.floor(F.col("c_custkey") / 100).cast("double").alias("y_px"), F.col("c_mktsegment").alias("cell_type"), "region")


def drawn(spark: SparkSession) -> DataFrame:
    rows = [(name, k, [{"x": x, "y": y} for x, y in ring]) for name, k, ring in REGIONS]
    return spark.createDataFrame(rows, "region string, ord int, ring array<struct<x:double,y:double>>")


def clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vector")), rows.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("cluster_id"))


CM = "cm AS (SELECT user_id + 1 AS cell_id, event_type AS marker, count(value) AS n, sum(value) AS s, avg(value) AS mean FROM events GROUP BY 1, 2)"
HIST = f"""{CM}, pos AS (SELECT marker, mean AS v FROM cm WHERE mean > 0 AND marker IN (SELECT marker FROM cm WHERE mean > 0 GROUP BY 1 HAVING count(*) > 1)),
ends AS (SELECT marker, min(v) AS lo, max(v) AS hi FROM pos GROUP BY 1),
cnt AS (SELECT marker, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INT) AS bin, count(*) AS h FROM pos JOIN ends USING (marker) GROUP BY 1, 2),
hist AS (SELECT e.marker, lo, hi, g.bin, coalesce(h, 0) AS h, lo + (g.bin + 0.5) * (hi - lo) / 256 AS c
  FROM ends e CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(256)) g LEFT JOIN cnt ON cnt.marker = e.marker AND cnt.bin = g.bin)"""
CUM = """cum AS (SELECT *, sum(h) OVER b AS w1, sum(h * c) OVER b AS s1, sum(h) OVER a AS w2, sum(h * c) OVER a AS s2 FROM hist
  WINDOW b AS (PARTITION BY marker ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY marker ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
OTSU = f"""{HIST}, {CUM}, thr AS (SELECT marker, c AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY w1 * w2 * (s1 / w1 - s2 / w2) * (s1 / w1 - s2 / w2) DESC, bin) AS k
  FROM cum WHERE w1 > 0 AND w2 > 0) WHERE k = 1)"""
POS = f"{OTSU}, pos2 AS (SELECT cell_id, marker, CASE WHEN mean >= threshold THEN 2 ELSE 1 END AS state FROM cm JOIN thr USING (marker))"
RULE_ROWS = ", ".join(f"({o}, '{t}', '{m}', {r})" for o, t, m, r in RULES)
GATE = f"""{POS}, rules(type_ord, cell_type, marker, required) AS (VALUES {RULE_ROWS}),
typed AS (SELECT cell_id, cell_type FROM pos2 JOIN rules USING (marker) WHERE (required = 1) = (state = 2) GROUP BY cell_id, cell_type
  HAVING count(*) = (SELECT count(*) FROM rules r WHERE r.cell_type = rules.cell_type)),
gated AS (SELECT * FROM typed UNION ALL SELECT cell_id, 'Unknown' FROM (SELECT DISTINCT cell_id FROM pos2) WHERE cell_id NOT IN (SELECT cell_id FROM typed))"""
RUNS = """runs AS (SELECT l_linestatus AS mask_id, l_suppkey AS y, l_orderkey % 512 * 16 + l_linenumber AS x0, l_orderkey % 512 * 16 + l_linenumber + CAST(l_quantity AS BIGINT) AS x1, l_orderkey + 1 AS label FROM lineitem)"""
PIX = f"{RUNS}, pix AS (SELECT mask_id, y, unnest(range(x0, x1)) AS x, label FROM runs)"
CELLS = """cells AS (SELECT c_custkey AS cell_id, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey // 100 AS DOUBLE) AS y, c_mktsegment AS cell_type, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EDGES = "edges(region, ord, xa, ya, xb, yb) AS (VALUES " + ", ".join(f"('{n}', {o}, {ring[k][0]}, {ring[k][1]}, {ring[(k + 1) % len(ring)][0]}, {ring[(k + 1) % len(ring)][1]})" for n, o, ring in REGIONS for k in range(len(ring))) + ")"
INSIDE = f"""{CELLS}, {EDGES}, inside AS (SELECT cell_id, e.region, ord FROM cells, edges e WHERE (ya > y) != (yb > y) AND x < (xb - xa) * (y - ya) / (yb - ya) + xa GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
placed AS (SELECT c.cell_id, coalesce(arg_min(i.region, i.ord), 'outside') AS region, count(DISTINCT i.region) > 1 AS ambiguous FROM cells c LEFT JOIN inside i USING (cell_id) GROUP BY 1)"""
VEC = "vec AS (SELECT vec_id AS cell_id, label AS cluster_id, k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(k))"


# ---- measures


@query(f"WITH {CM} SELECT cell_id, marker, n, round(s, 6) AS sum, round(mean, 6) AS mean FROM cm")
def cell_mean(spark, sf_dir):
    return rounded(cell_marker(spark, sf_dir))


CHANNELS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query("SELECT l_partkey AS cell_id, count(*) AS area_px, round(avg(l_quantity), 6) AS quantity_mean, round(avg(l_extendedprice), 6) AS price_mean, round(avg(l_discount) + 0.0, 6) AS discount_mean, round(avg(l_tax) + 0.0, 6) AS tax_mean FROM lineitem GROUP BY 1")
def cell_mean_wide(spark, sf_dir):
    return rounded(M.cell_means_wide(table(spark, sf_dir, "lineitem"), "l_partkey", CHANNELS))


@query(f"""WITH {RUNS} SELECT mask_id, label AS cell_id, CAST(sum(x1 - x0) AS BIGINT) AS area_px, round(sum((x0 + x1 - 1) / 2.0 * (x1 - x0)) / sum(x1 - x0), 6) AS x_px, round(sum(CAST(y AS DOUBLE) * (x1 - x0)) / sum(x1 - x0), 6) AS y_px,
 min(y) AS ymin, min(x0) AS xmin, max(y) + 1 AS ymax, max(x1) AS xmax FROM runs GROUP BY 1, 2""")
def cell_geometry_runs(spark, sf_dir):
    return rounded(M.cell_geometry(runs(spark, sf_dir)))


@query("SELECT event_type AS marker, CASE WHEN max(value) > 0 THEN max(value) ELSE 1.0 END AS data_max FROM events GROUP BY 1")
def channel_maxima(spark, sf_dir):
    return M.channel_maxima(pixels(spark, sf_dir))


@query("SELECT event_type AS marker, round(quantile_cont(value, 0.05), 6) AS range_min, round(quantile_cont(value, 0.95), 6) AS range_max FROM events GROUP BY 1")
def percentile_range(spark, sf_dir):
    return rounded(M.percentile_range(pixels(spark, sf_dir)))


@query(f"WITH {CM} SELECT cell_id, marker, n FROM cm WHERE cell_id IN (SELECT cell_id FROM cm WHERE marker = 'view' AND mean >= 45)")
def mean_filter(spark, sf_dir):
    cm = cell_marker(spark, sf_dir)
    return M.filter_mean(cm, cm, "view", 45.0).select("cell_id", "marker", "n")


# ---- thresholds, states and gating


@query(f"WITH {OTSU} SELECT marker, round(threshold, 6) AS threshold FROM thr")
def otsu_threshold(spark, sf_dir):
    return rounded(T.otsu(cell_marker(spark, sf_dir)))


@query(f"""WITH {HIST}, p AS (SELECT *, h / sum(h) OVER (PARTITION BY marker) AS p FROM hist),
q AS (SELECT *, sum(p) OVER b AS p1, sum(p * p) OVER b AS q1, sum(p * p) OVER a AS q2 FROM p WINDOW b AS (PARTITION BY marker ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY marker ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT marker, round(c, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY ln((p1 * (1 - p1)) * (p1 * (1 - p1)) / (q1 * q2)) DESC, bin) AS k FROM q WHERE q1 * q2 > 0 AND p1 * (1 - p1) > 0) WHERE k = 1""")
def yen_threshold(spark, sf_dir):
    return rounded(T.yen(cell_marker(spark, sf_dir)))


@query(f"""WITH {HIST}, {CUM} SELECT marker, round(min(c), 6) AS threshold FROM cum WHERE w1 > 0 AND w2 > 0 AND (s1 / w1 + s2 / w2) / 2 - c >= 0 AND (s1 / w1 + s2 / w2) / 2 - c < (hi - lo) / 256 GROUP BY 1""")
def isodata_threshold(spark, sf_dir):
    return rounded(T.isodata(cell_marker(spark, sf_dir)))


@query(f"""WITH {HIST}, pk AS (SELECT marker, arg_max(bin, h * 1000 - bin) AS top, max(h) AS height, min(bin) FILTER (h > 0) AS f, max(bin) FILTER (h > 0) AS l FROM hist GROUP BY 1),
e AS (SELECT marker, top, height, CASE WHEN top - f >= l - top THEN f ELSE l END AS en FROM pk)
SELECT marker, round(c, 6) AS threshold FROM (SELECT marker, c, row_number() OVER (PARTITION BY marker ORDER BY height * abs(bin - en) - abs(top - en) * h DESC, abs(bin - en)) AS k FROM hist JOIN e USING (marker)
 WHERE bin != top AND bin BETWEEN least(top, en) AND greatest(top, en)) WHERE k = 1""")
def triangle_threshold(spark, sf_dir):
    return rounded(T.triangle(cell_marker(spark, sf_dir)))


@query(f"""WITH RECURSIVE {CM}, pos AS (SELECT marker, mean AS v FROM cm WHERE mean > 0 AND marker IN (SELECT marker FROM cm WHERE mean > 0 GROUP BY 1 HAVING count(*) > 1)),
gaps AS (SELECT marker, v - lag(v) OVER (PARTITION BY marker ORDER BY v) AS gap FROM (SELECT DISTINCT marker, v FROM pos)), tol AS (SELECT marker, coalesce(min(gap), 0) / 2 AS tol FROM gaps GROUP BY 1),
it AS (SELECT marker, 0 AS k, min(v) AS lo, avg(v) - min(v) AS t, any_value(tol) AS tol, false AS done FROM pos JOIN tol USING (marker) GROUP BY 1
 UNION ALL SELECT marker, k + 1, lo, (back - fore) / (ln(back) - ln(fore)), tol, abs((back - fore) / (ln(back) - ln(fore)) - t) <= tol
 FROM (SELECT it.marker, k, lo, t, tol, avg(v - lo) FILTER (v - lo > t) AS fore, avg(v - lo) FILTER (v - lo <= t) AS back FROM it JOIN pos USING (marker) WHERE NOT done AND k < 500 GROUP BY 1, 2, 3, 4, 5) WHERE fore > 0 AND back > 0 AND fore != back)
SELECT marker, round(arg_max(lo + t, k), 6) AS threshold FROM it GROUP BY 1""")
def li_threshold(spark, sf_dir):
    return rounded(T.li(cell_marker(spark, sf_dir)))


@query(f"WITH {POS} SELECT cell_id, marker, state FROM pos2")
def positivity(spark, sf_dir):
    cm = cell_marker(spark, sf_dir)
    return G.positivity(cm, T.thresholds(cm, "otsu"))


@query(f"WITH {OTSU} SELECT marker, CAST(count(*) FILTER (mean >= threshold) AS BIGINT) AS n_positive, CAST(count(*) FILTER (mean > 0) AS BIGINT) AS n_with_signal FROM cm JOIN thr USING (marker) GROUP BY 1")
def positive_counts(spark, sf_dir):
    cm = cell_marker(spark, sf_dir)
    return M.positive_counts(cm, T.otsu(cm))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate(positivity(spark, sf_dir), phenotypes(spark))


@query(f"WITH {GATE} SELECT cell_type, count(*) AS n_cells, count(DISTINCT cell_id) AS n_distinct FROM gated GROUP BY 1")
def gating_multi(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("cell_type").agg(F.count("*").alias("n_cells"), F.count_distinct("cell_id").alias("n_distinct"))


@query(f"WITH {GATE} SELECT cell_id FROM gated WHERE cell_type = 'Unknown'")
def gating_unknown(spark, sf_dir):
    return gated(spark, sf_dir).where("cell_type = 'Unknown'").select("cell_id")


@query(f"""WITH {GATE} SELECT c.cell_id, coalesce(t.phenotype, 'Unknown') AS phenotype, c.click_mean, c.view_mean, coalesce(p.click_positive, false) AS click_positive, coalesce(p.view_positive, false) AS view_positive
FROM (SELECT cell_id, round(max(mean) FILTER (marker = 'click'), 6) AS click_mean, round(max(mean) FILTER (marker = 'view'), 6) AS view_mean FROM cm GROUP BY 1) c
LEFT JOIN (SELECT cell_id, bool_or(state = 2) FILTER (marker = 'click') AS click_positive, bool_or(state = 2) FILTER (marker = 'view') AS view_positive FROM pos2 GROUP BY 1) p USING (cell_id)
LEFT JOIN (SELECT cell_id, arg_max(cell_type, CASE cell_type WHEN 'buyer' THEN 0 WHEN 'viewer' THEN 1 WHEN 'noisy' THEN 2 ELSE 3 END) AS phenotype FROM gated GROUP BY 1) t USING (cell_id)""")
def cell_table(spark, sf_dir):
    cm = cell_marker(spark, sf_dir)
    states = G.positivity(cm, T.otsu(cm))
    out = M.cell_table(cm.select("cell_id").distinct(), cm, ["click", "view"], states, types=G.gate(states, phenotypes(spark)))
    return rounded(out).select("cell_id", "phenotype", "click_mean", "view_mean", "click_positive", "view_positive")


STATES = "st AS (SELECT o_custkey AS cell_id, o_orderpriority AS marker, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS state FROM orders GROUP BY 1, 2), cl AS (SELECT c_custkey AS cell_id, c_nationkey AS cluster_id FROM customer)"
CSTATES = f"{STATES}, cs AS (SELECT cluster_id, marker, avg(CASE WHEN state > 0 THEN CAST(state = 2 AS INT) END) AS fraction FROM cl JOIN st USING (cell_id) GROUP BY 1, 2), cst AS (SELECT *, CASE WHEN fraction >= 0.6 THEN 1 WHEN fraction <= 0.2 THEN 2 ELSE 0 END AS state FROM cs)"


def _order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    code = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    states = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("marker")).agg(F.max(code).alias("state"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("cluster_id")), states


@query(f"WITH {CSTATES} SELECT cluster_id, marker, round(fraction, 6) AS fraction, state FROM cst")
def cluster_states(spark, sf_dir):
    return rounded(G.cluster_states(*_order_states(spark, sf_dir)))


CLUSTER_RULES = [(0, "urgent", "1-URGENT", 1), (0, "urgent", "2-HIGH", 1), (1, "low", "5-LOW", 1), (2, "high", "2-HIGH", 1)]


@query(f"""WITH {CSTATES}, rules(type_ord, cell_type, marker, required) AS (VALUES {", ".join(f"({o}, '{t}', '{m}', {r})" for o, t, m, r in CLUSTER_RULES)}),
fit AS (SELECT cluster_id, type_ord, cell_type FROM cst JOIN rules USING (marker) WHERE state = required GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM rules r WHERE r.cell_type = rules.cell_type))
SELECT c.cluster_id, coalesce(arg_min(f.cell_type, f.type_ord), 'Unknown') AS cell_type FROM (SELECT DISTINCT cluster_id FROM cst) c LEFT JOIN fit f USING (cluster_id) GROUP BY 1""")
def cluster_type(spark, sf_dir):
    rules = spark.createDataFrame(CLUSTER_RULES, "type_ord int, cell_type string, marker string, required int")
    return G.name_clusters(G.cluster_states(*_order_states(spark, sf_dir)), rules)


# ---- normalisation, clusters, neighbours

Z = "SELECT cell_id, marker, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 5) + 0.0 AS value FROM {source} WINDOW w AS (PARTITION BY marker)"


@query(f"WITH {CM} " + Z.format(source="(SELECT cell_id, marker, mean AS v FROM cm)"))
def zscore(spark, sf_dir):
    return rounded(N.zscore(cell_marker(spark, sf_dir)), 5)


@query(f"WITH {CM} SELECT cell_id, marker, round((mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w), 6) AS value FROM cm WINDOW w AS (PARTITION BY marker)")
def minmax(spark, sf_dir):
    return rounded(N.minmax(cell_marker(spark, sf_dir)))


@query(f"WITH {CM} " + Z.format(source="(SELECT cell_id, marker, asinh(mean / 5) AS v FROM cm)"))
def arcsinh_z(spark, sf_dir):
    return rounded(N.arcsinh(cell_marker(spark, sf_dir)), 5)


@query("""WITH b AS (SELECT l_partkey AS cell_id, u.marker, CAST(u.v AS DOUBLE) AS m FROM (SELECT l_partkey, max(l_extendedprice) AS price, max(l_quantity) * max(l_quantity) * max(l_quantity) / (1 + min(l_quantity)) AS ratio FROM lineitem GROUP BY 1), LATERAL (VALUES ('price', price), ('ratio', ratio)) u(marker, v)),
k AS (SELECT marker, avg(m) AS mu, stddev_pop(m) AS sd FROM b GROUP BY 1), sk AS (SELECT b.marker, avg(((m - mu) / sd) * ((m - mu) / sd) * ((m - mu) / sd)) AS skew FROM b JOIN k USING (marker) GROUP BY 1),
v AS (SELECT cell_id, marker, CASE WHEN abs(skew) > 1 THEN ln(1 + m) ELSE m END AS v FROM b JOIN sk USING (marker)) """ + Z.format(source="v"))
def log_z(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.max("l_extendedprice").alias("price"), (F.max("l_quantity") * F.max("l_quantity") * F.max("l_quantity") / (1 + F.min("l_quantity"))).alias("ratio"))
    return rounded(N.log_zscore(wide.unpivot("cell_id", ["price", "ratio"], "marker", "mean")), 5)


@query()
def yeo_johnson(spark, sf_dir):
    return rounded(N.yeo_johnson_zscore(cell_marker(spark, sf_dir)), 4)


@query(f"WITH {VEC} SELECT cluster_id, CAST(k AS VARCHAR) AS marker, round(avg(x), 6) AS value FROM vec GROUP BY 1, 2")
def cluster_heatmap(spark, sf_dir):
    vectors, clusters = clustered(spark, sf_dir)
    long = vectors.select("cell_id", F.posexplode("vector").alias("k", "mean")).select("cell_id", (F.col("k") + 1).cast("string").alias("marker"), "mean")
    return rounded(C.heatmap(long, clusters))


@query(f"WITH {VEC}, h AS (SELECT cluster_id, CAST(k AS VARCHAR) AS marker, avg(x) AS v FROM vec GROUP BY 1, 2) SELECT cluster_id, marker, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 5) AS value FROM h WINDOW w AS (PARTITION BY marker)")
def cluster_heatmap_scaled(spark, sf_dir):
    vectors, clusters = clustered(spark, sf_dir)
    long = vectors.select("cell_id", F.posexplode("vector").alias("k", "mean")).select("cell_id", (F.col("k") + 1).cast("string").alias("marker"), "mean")
    return rounded(C.heatmap(long, clusters, scaled=True), 5)


@query("SELECT label AS cluster_id, 'Cluster ' || label AS name, count(*) AS n_cells, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf_dir):
    return rounded(C.cluster_report(clustered(spark, sf_dir)[1]))


CENTRES = f"{VEC}, ce AS (SELECT cluster_id, k, avg(x) AS m FROM vec GROUP BY 1, 2), di AS (SELECT v.cluster_id, v.cell_id, sqrt(sum((x - m) * (x - m))) AS d FROM vec v JOIN ce USING (cluster_id, k) GROUP BY 1, 2)"


@query(f"""WITH {CENTRES}, s AS (SELECT cluster_id, avg(d) AS s FROM di GROUP BY 1), p AS (SELECT a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM ce a JOIN ce b ON a.k = b.k AND a.cluster_id != b.cluster_id GROUP BY 1, 2)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT i, max((a.s + b.s) / d) AS r FROM p JOIN s a ON a.cluster_id = i JOIN s b ON b.cluster_id = j GROUP BY 1)""")
def davies_bouldin(spark, sf_dir):
    return rounded(C.davies_bouldin(*clustered(spark, sf_dir)))


@query(f"""WITH {CENTRES}, g AS (SELECT k, avg(x) AS m FROM vec GROUP BY 1), n AS (SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1),
b AS (SELECT sum(n * (ce.m - g.m) * (ce.m - g.m)) AS b FROM ce JOIN g USING (k) JOIN n USING (cluster_id)), w AS (SELECT sum(d * d) AS w, count(*) AS n FROM di), q AS (SELECT count(*) AS q FROM n)
SELECT round((b / (q - 1)) / (w / (n - q)), 5) AS calinski_harabasz FROM b, w, q""")
def calinski_harabasz(spark, sf_dir):
    return rounded(C.calinski_harabasz(*clustered(spark, sf_dir)), 5)


DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT cell_id, rank, round(distance, 5) AS distance FROM (SELECT a.vec_id AS cell_id, {DIST} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id) WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    return rounded(knn(clustered(spark, sf_dir)[0], 5).select("cell_id", F.col("rank").cast("long").alias("rank"), "distance"), 5)


@query(f"SELECT a.vec_id AS cell_id, count(*) AS n FROM embeddings a JOIN embeddings b ON {DIST} <= 1.15 GROUP BY 1 HAVING count(*) >= 5")
def dbscan_core(spark, sf_dir):
    return K.reach_counts(clustered(spark, sf_dir)[0], 1.15).where("n >= 5")


# ---- masks


@query(f"WITH {RUNS}, a AS (SELECT mask_id, label, sum(x1 - x0) AS n FROM runs GROUP BY 1, 2) SELECT r.mask_id, r.y, r.x0, r.x1, r.label FROM runs r JOIN a USING (mask_id, label) WHERE n BETWEEN 10 AND 60")
def size_filter(spark, sf_dir):
    return L.filter_size(runs(spark, sf_dir), 10, 60)


@query(f"WITH {RUNS} SELECT a.mask_id AS a_mask, a.label AS a, b.mask_id AS b_mask, b.label AS b, CAST(sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS BIGINT) AS pixels FROM runs a JOIN runs b ON a.y = b.y AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE a.mask_id = 'F' AND b.mask_id = 'O' GROUP BY 1, 2, 3, 4")
def mask_overlap(spark, sf_dir):
    r = runs(spark, sf_dir)
    return L.overlaps(r.where("mask_id = 'F'"), r.where("mask_id = 'O'"))


@query(f"""WITH {RUNS}, gone AS (SELECT DISTINCT a.label FROM runs a JOIN runs b ON a.y = b.y AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE a.mask_id = 'F' AND b.mask_id = 'O')
SELECT mask_id, y, x0, x1, label FROM runs WHERE mask_id = 'F' AND label NOT IN (SELECT label FROM gone) UNION ALL SELECT mask_id, y, x0, x1, label + (SELECT max(label) FROM runs WHERE mask_id = 'F') FROM runs WHERE mask_id = 'O'""")
def mask_simple_merge(spark, sf_dir):
    return L.merge_masks(runs(spark, sf_dir), mask_order(spark))


@query(f"WITH {PIX}, u AS (SELECT mask_id, y, x, max(label) AS label FROM pix GROUP BY 1, 2, 3), g AS (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y, label ORDER BY x) AS grp FROM u) SELECT mask_id, y, min(x) AS x0, max(x) + 1 AS x1, label FROM g GROUP BY mask_id, y, label, grp")
def run_length_encode(spark, sf_dir):
    return L.flattened(runs(spark, sf_dir))


BINARY = f"{PIX}, fg AS (SELECT DISTINCT mask_id, y, x, y // 20 AS wy, x // 20 AS wx FROM pix)"


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flattened(runs(spark, sf_dir).withColumn("label", F.lit(1)))


@query(f"""WITH {BINARY}, n AS (SELECT wy, wx, mask_id, count(*) AS n FROM fg GROUP BY 1, 2, 3), s AS (SELECT a.wy, a.wx, count(*) AS s FROM fg a JOIN fg b ON a.y = b.y AND a.x = b.x AND a.mask_id = 'F' AND b.mask_id = 'O' GROUP BY 1, 2)
SELECT a.wy, a.wx, 'F' AS a_mask, 'O' AS b_mask, CAST(coalesce(s, 0) AS BIGINT) AS shared, CAST(a.n + b.n - coalesce(s, 0) AS BIGINT) AS joint, round(coalesce(s, 0) / (a.n + b.n - coalesce(s, 0)), 6) AS jaccard
FROM n a JOIN n b ON a.wy = b.wy AND a.wx = b.wx AND a.mask_id = 'F' AND b.mask_id = 'O' LEFT JOIN s ON s.wy = a.wy AND s.wx = a.wx""")
def jaccard_window(spark, sf_dir):
    return rounded(L.window_jaccard(_binary(spark, sf_dir), 20))


@query(f"""WITH {PIX}, p AS (SELECT y // 20 AS wy, x // 20 AS wx, mask_id, count(DISTINCT label) + 1 AS n FROM pix GROUP BY 1, 2, 3)
SELECT wy, wx, mask_id, CAST(n AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY wy, wx ORDER BY n DESC, mask_id) AS k FROM p) WHERE k = 1""")
def window_winner(spark, sf_dir):
    return L.window_winner(L.window_stats(runs(spark, sf_dir), 20), None, mask_order(spark), "pop")


@query(f"""WITH {PIX}, b AS (SELECT DISTINCT y, x FROM pix WHERE mask_id = 'O'), ar AS (SELECT label, sum(x1 - x0) AS area FROM runs WHERE mask_id = 'F' GROUP BY 1),
ov AS (SELECT label, count(*) AS n FROM pix JOIN b USING (y, x) WHERE mask_id = 'F' GROUP BY 1) SELECT 'F' AS mask_id, label AS cell_id, round(n / area, 6) AS coverage FROM ar JOIN ov USING (label) WHERE n / area >= 0.5""")
def cells_in_mask(spark, sf_dir):
    return rounded(L.cells_in_mask(runs(spark, sf_dir).where("mask_id = 'F'"), _binary(spark, sf_dir).where("mask_id = 'O'")))


@query(f"""WITH {PIX}, u AS (SELECT y, x, max(label) AS label FROM pix WHERE mask_id = 'F' GROUP BY 1, 2), b AS (SELECT DISTINCT y, x FROM pix WHERE mask_id = 'O')
SELECT CAST(count(*) AS BIGINT) AS pixels, CAST(sum(label) AS BIGINT) AS label_sum FROM u ANTI JOIN b USING (y, x)""")
def mask_subtract(spark, sf_dir):
    r = runs(spark, sf_dir)
    left = L.cut_by(L.flattened(r.where("mask_id = 'F'")), r.where("mask_id = 'O'"))
    return left.agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"), F.sum((F.col("x1") - F.col("x0")) * F.col("label")).cast("long").alias("label_sum"))


FUSED = f"""{PIX}, u AS (SELECT mask_id, CASE mask_id WHEN 'F' THEN 0 ELSE 1 END AS ord, y, x, x // 16 AS s, max(label) AS label FROM pix GROUP BY 1, 2, 3, 4),
ext AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM u),
c AS (SELECT ord, label, count(*) AS area, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx, min(y * 100000 + x) AS head FROM u GROUP BY 1, 2),
gr AS (SELECT ceil(quantile_cont(area, 0.32) * 0.05) AS g FROM c),
best AS (SELECT wy, wx, arg_min(ord, ord - 10 * n) AS ord FROM (SELECT y // 20 AS wy, x // 20 AS wx, ord, count(DISTINCT label) AS n FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2),
cw AS (SELECT *, unnest(range(CAST(greatest(floor((cx - g) / 20), 0) AS BIGINT), CAST(least(ceil((cx + g) / 20), (w + 19) // 20) AS BIGINT))) AS wx
  FROM (SELECT c.*, g, w, unnest(range(CAST(greatest(floor((cy - g) / 20), 0) AS BIGINT), CAST(least(ceil((cy + g) / 20), (h + 19) // 20) AS BIGINT))) AS wy FROM c, gr, ext)),
ad AS (SELECT cw.ord, label, any_value(area) AS area, any_value(cy) AS cy, any_value(cx) AS cx, any_value(head) AS head, min(wy * 100000 + wx) AS a, max(wy * 100000 + wx) AS b
  FROM cw LEFT JOIN best k USING (wy, wx) WHERE cw.ord = coalesce(k.ord, 0) GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (ORDER BY a, ord, head) AS fi, row_number() OVER (ORDER BY b, ord, head) AS la, sqrt(area / pi()) AS r, CAST(floor(cx / 64) AS BIGINT) AS k FROM ad),
nr AS (SELECT p.fi AS i, q.fi AS j, q.ord, q.cy, q.cx FROM (SELECT *, unnest([k - 1, k, k + 1]) AS kk FROM a) p JOIN a q ON p.kk = q.k AND abs(p.cy - q.cy) < p.r AND abs(p.cx - q.cx) < p.r),
bx AS (SELECT i, greatest(CAST(trunc(min(cy) - 2) AS BIGINT), 0) AS y0, least(CAST(trunc(max(cy) + 2) AS BIGINT), any_value(h)) AS y1, greatest(CAST(trunc(min(cx) - 2) AS BIGINT), 0) AS x0, least(CAST(trunc(max(cx) + 2) AS BIGINT), any_value(w)) AS x1
  FROM nr, ext GROUP BY 1 HAVING min(ord) < max(ord)),
bp AS (SELECT i, y, x0, x1, unnest(range(x0 // 16, (x1 - 1) // 16 + 1)) AS s FROM (SELECT *, unnest(range(y0, y1)) AS y FROM bx)),
cl AS (SELECT i FROM (SELECT DISTINCT i, u.y, u.x FROM bp JOIN u ON u.y = bp.y AND u.s = bp.s AND u.x >= x0 AND u.x < x1) GROUP BY 1 HAVING count(*) > 3),
gp AS (SELECT j AS fi, min(i) AS g FROM nr SEMI JOIN cl USING (i) GROUP BY 1),
hd AS (SELECT g, arg_min(cy, fi) AS cy, arg_min(cx, fi) AS cx FROM gp JOIN a USING (fi) GROUP BY 1),
hb AS (SELECT g, greatest(CAST(trunc(cy - 10) AS BIGINT), 0) AS y0, CASE WHEN trunc(cy + 10) > h - 10 THEN h ELSE CAST(trunc(cy + 10) AS BIGINT) END AS y1, greatest(CAST(trunc(cx - 10) AS BIGINT), 0) AS x0, CASE WHEN trunc(cx + 10) > w - 10 THEN w ELSE CAST(trunc(cx + 10) AS BIGINT) END AS x1 FROM hd, ext),
hp AS (SELECT g, y, x0, x1, unnest(range(x0 // 16, (x1 - 1) // 16 + 1)) AS s FROM (SELECT *, unnest(range(y0, y1)) AS y FROM hb)),
hs AS (SELECT g, ord, count(DISTINCT label) AS n FROM hp JOIN u ON u.y = hp.y AND u.s = hp.s AND u.x >= x0 AND u.x < x1 GROUP BY 1, 2),
op AS (SELECT DISTINCT g, ord FROM gp JOIN a USING (fi)), hw AS (SELECT g, arg_min(ord, ord - 10 * coalesce(n, 0)) AS win FROM op LEFT JOIN hs USING (g, ord) GROUP BY 1),
kp AS (SELECT a.*, greatest(CAST(trunc(cy) AS BIGINT), 1) AS iy, greatest(CAST(trunc(cx) AS BIGINT), 1) AS ix FROM a LEFT JOIN gp USING (fi) LEFT JOIN hw USING (g) WHERE win IS NULL OR win = ord),
sh AS (SELECT fi, kp.ord, kp.label, la, iy, ix, max(u.label) AS shown FROM (SELECT *, unnest([iy - 1, iy, iy - 1, iy]) AS py, unnest([ix - 1, ix - 1, ix, ix]) AS px FROM kp) kp JOIN u ON u.ord = kp.ord AND u.y = py AND u.x = px GROUP BY 1, 2, 3, 4, 5, 6),
pt AS (SELECT u.y, u.x, arg_max(sh.label + CASE WHEN sh.ord = 1 THEN (SELECT max(label) FROM u WHERE ord = 0) ELSE 0 END, la) AS label, arg_max(mask_id, la) AS method
  FROM sh JOIN u ON u.ord = sh.ord AND u.label = shown AND u.y >= iy - 100 AND u.y < iy + 100 AND u.x >= ix - 100 AND u.x < ix + 100 GROUP BY 1, 2)"""


@query(f"WITH {FUSED} SELECT 'fused' AS mask_id, y, min(x) AS x0, max(x) + 1 AS x1, label, method FROM (SELECT *, x - row_number() OVER (PARTITION BY y, label, method ORDER BY x) AS g FROM pt) GROUP BY y, label, method, g")
def mask_fusion(spark, sf_dir):
    """Two masks made one by the merit of their windows; clashes judged again, cells painted in order."""
    return fuse_masks(run_length_encode(spark, sf_dir), mask_order(spark), "pop", 20)


# ---- regions


@query(f"WITH {INSIDE} SELECT cell_id, region, ambiguous FROM placed")
def region_assign(spark, sf_dir):
    return R.assign_regions(located(spark, sf_dir), drawn(spark))


@query(f"WITH {INSIDE}, t AS (SELECT count(*) AS n FROM cells) SELECT region, n_cells, round(100.0 * n_cells / n, 6) AS percent FROM (SELECT region, count(DISTINCT cell_id) AS n_cells FROM inside GROUP BY 1 UNION ALL SELECT 'assigned', count(DISTINCT cell_id) FROM inside UNION ALL SELECT 'unassigned', count(*) FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM inside)), t")
def cells_per_region(spark, sf_dir):
    cells = located(spark, sf_dir)
    return rounded(R.cells_per_region(R.cells_in_regions(cells, drawn(spark)), cells))


@query(f"WITH {CELLS} SELECT cell_type, count(*) FILTER (region = 'ASIA') AS n_ASIA, count(*) FILTER (region = 'EUROPE') AS n_EUROPE, round(100.0 * count(*) FILTER (region = 'ASIA') / (SELECT count(*) FROM cells WHERE region = 'ASIA'), 6) AS percent_ASIA, round(100.0 * count(*) FILTER (region = 'EUROPE') / (SELECT count(*) FROM cells WHERE region = 'EUROPE'), 6) AS percent_EUROPE, count(*) FILTER (region NOT IN ('ASIA', 'EUROPE')) AS n_outside, count(*) AS n_total FROM cells GROUP BY 1")
def region_counts(spark, sf_dir):
    return rounded(R.region_counts(located(spark, sf_dir), ["ASIA", "EUROPE"]))


AB = f"{CELLS}, ab AS (SELECT cell_type, count(*) FILTER (region = 'ASIA') AS a, count(*) FILTER (region = 'EUROPE') AS b FROM cells GROUP BY 1), n AS (SELECT count(*) FILTER (region = 'ASIA') AS na, count(*) FILTER (region = 'EUROPE') AS nb FROM cells)"


@query(f"WITH {AB}, p AS (SELECT cell_type, a / na AS pa, b / nb AS pb FROM ab, n) SELECT cell_type, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round((pa - pb) * (pa - pb) / (pa * (1 - pa) + pb * (1 - pb)), 6) AS separation FROM p")
def fisher_j(spark, sf_dir):
    cells = located(spark, sf_dir)
    return rounded(R.fisher(cells, cells, "ASIA", "EUROPE").select("cell_type", "p_a", "p_b", "separation"))


@query(f"WITH {AB} SELECT cell_type, a AS in_a, b AS in_b, round(a * (nb - b) / ((na - a) * b), 6) AS odds_ratio, round(log2(a * (nb - b) / ((na - a) * b)), 6) AS log2_odds_ratio FROM ab, n")
def odds_ratio(spark, sf_dir):
    cells = located(spark, sf_dir)
    return rounded(R.odds_ratios(cells, cells, "ASIA", "EUROPE").select("cell_type", "in_a", "in_b", "odds_ratio", "log2_odds_ratio"))


@query(f"""WITH {CELLS}, c AS (SELECT cell_type, count(*) AS n, count(*) FILTER (region = 'ASIA') AS n_in FROM cells GROUP BY 1 UNION ALL SELECT 'pooled', count(*), count(*) FILTER (region = 'ASIA') FROM cells WHERE lower(cell_type) LIKE '%auto%' OR lower(cell_type) LIKE '%build%'),
b AS (SELECT count(*) FILTER (region = 'ASIA') / count(*) AS baseline FROM cells) SELECT cell_type, n, n_in, round(n_in / n, 6) AS share, round(baseline, 6) AS baseline, round(n_in / n / baseline, 6) AS enrichment, n = 0 AS none_found FROM c, b""")
def enrichment(spark, sf_dir):
    cells = located(spark, sf_dir)
    return rounded(R.enrichment(cells, cells, "ASIA", ("auto", "build")))


@query(f"""WITH {AB}, s AS (SELECT sum(a) AS sa, sum(b) AS sb FROM ab), p AS (SELECT a / sa AS p, b / sb AS q, (a / sa + b / sb) / 2 AS m FROM ab, s)
SELECT round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sqrt(sum(p * log2(p / m) + q * log2(q / m)) / 2), 6) AS jensen_shannon FROM p""")
def composition_tv_js(spark, sf_dir):
    return rounded(R.composition_distance(located(spark, sf_dir), "ASIA", "EUROPE"))


@query("SELECT o_orderpriority AS sample, o_orderstatus AS method, round(median(o_totalprice), 3) AS median_o_totalprice FROM orders GROUP BY 1, 2")
def median_by_method(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "sample", "o_orderstatus": "method"})
    return R.median_by(rows, ["sample", "method"], ["o_totalprice"])


PARTS = "pt AS (SELECT p_brand AS cell_type, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'AI' ELSE 'Otsu' END AS method, p_partkey, p_size FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "AI").otherwise("Otsu")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("cell_type"), method.alias("method"), F.col("p_size").alias("cell_id"))


@query(f"WITH {PARTS}, c AS (SELECT cell_type, method, count(*) AS n FROM pt GROUP BY 1, 2) SELECT t.cell_type, m.method, coalesce(n, 0) AS n FROM (SELECT DISTINCT cell_type FROM c) t CROSS JOIN (SELECT DISTINCT method FROM c) m LEFT JOIN c ON c.cell_type = t.cell_type AND c.method = m.method")
def types_union(spark, sf_dir):
    return R.align_types(_parts(spark, sf_dir).groupBy("cell_type", "method").agg(F.count("*").alias("n")))


@query("""WITH c AS (SELECT p_brand AS cell_type, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'AI' ELSE 'Otsu' END AS method, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1, 2), t AS (SELECT cell_type, min(k) AS k FROM c GROUP BY 1)
SELECT t.cell_type, m.method, coalesce(n, 0) AS n, row_number() OVER (ORDER BY t.k, m.method) AS place FROM t CROSS JOIN (SELECT DISTINCT method FROM c) m LEFT JOIN c ON c.cell_type = t.cell_type AND c.method = m.method""")
def types_in_seen_order(spark, sf_dir):
    """The union of both methods' types in the order in which parts first show them."""
    method = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "AI").otherwise("Otsu")
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cell_type"), method.alias("method")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    place = F.row_number().over(Window.orderBy("seen", "method"))  # a row a type and method
    return R.align_types(counts, seen="seen").select("cell_type", "method", "n", place.cast("long").alias("place"))


@query(f"WITH {PARTS}, c AS (SELECT cell_type, method, count(*) AS n FROM pt GROUP BY 1, 2) SELECT * FROM c WHERE cell_type IN (SELECT cell_type FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT method) FROM c))")
def types_shared(spark, sf_dir):
    return R.align_types(_parts(spark, sf_dir).groupBy("cell_type", "method").agg(F.count("*").alias("n")), "shared")


@query(f"""WITH {PARTS}, a AS (SELECT DISTINCT cell_type, p_size FROM pt WHERE method = 'AI'), b AS (SELECT DISTINCT cell_type, p_size FROM pt WHERE method = 'Otsu')
SELECT coalesce(a.cell_type, b.cell_type) AS cell_type, count(a.p_size) AS n_left, count(b.p_size) AS n_right, bool_and(a.p_size IS NOT NULL AND b.p_size IS NOT NULL) AS same_members, count(b.p_size) - count(a.p_size) AS delta FROM a FULL JOIN b ON a.cell_type = b.cell_type AND a.p_size = b.p_size GROUP BY 1""")
def compare_calls(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    return R.compare_calls(rows.where("method = 'AI'"), rows.where("method = 'Otsu'"))


# ---- names, panels, rule tables


@query("SELECT p_brand AS name, dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INT)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()  # the names of a catalogue
    return names.selectExpr("name").withColumn("key", natural_key(F.col("name"))).selectExpr("name", "cast(dense_rank() over (order by key) as bigint) as place")


@query("SELECT n_nationkey, replace(r_name, ' ', '_') || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS safe_name FROM (SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)")
def unique_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return safe_names(names, "r_name", "n_nationkey").select("n_nationkey", "safe_name")


@query("SELECT o_orderpriority AS marker, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def rules_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("marker")).pivot("o_orderstatus", ["F", "O", "P"]).count()


@query("SELECT l_partkey, c AS marker, round(avg(v) + 0.0, 6) AS mean FROM (SELECT l_partkey, unnest(['l_discount', 'l_quantity', 'l_tax']) AS c, unnest([l_discount, l_quantity, l_tax]) AS v FROM lineitem) GROUP BY 1, 2")
def rules_unpivot(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").unpivot("l_partkey", ["l_quantity", "l_discount", "l_tax"], "marker", "value")
    return rounded(long.groupBy("l_partkey", "marker").agg(F.avg("value").alias("mean")))


# ---- iterative and fitted operators: no SQL form


@query()
def kmeans(spark, sf_dir):
    return C.kmeans(clustered(spark, sf_dir)[0], 5, restarts=3)


@query()
def pca(spark, sf_dir):
    return C.pca(clustered(spark, sf_dir)[0], 4)


@query()
def project_2d(spark, sf_dir):
    return C.project_2d(clustered(spark, sf_dir)[0])


@query()
def flowsom(spark, sf_dir):
    return C.flowsom(clustered(spark, sf_dir)[0], 6, 6, 10)


@query(f"""WITH d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS c, sum({DIST}) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
k AS (SELECT i, max(s / nullif(n - 1, 0)) FILTER (c = own) AS a, min(s / n) FILTER (c != own) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette, count(*) AS n FROM k""")
def silhouette(spark, sf_dir):
    return rounded(C.silhouette(*clustered(spark, sf_dir)))


@query()
def hierarchical(spark, sf_dir):
    return C.hierarchical(clustered(spark, sf_dir)[0], 8, "average", "cosine")


DBSCAN = f"""WITH RECURSIVE pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {DIST} <= 1.15), co AS (SELECT a AS c FROM pr GROUP BY 1 HAVING count(*) >= 5),
ed AS (SELECT a, b FROM pr WHERE a IN (SELECT c FROM co) AND b IN (SELECT c FROM co)), re AS (SELECT c, c AS o FROM co UNION SELECT ed.b, re.o FROM re JOIN ed ON ed.a = re.c),
pa AS (SELECT c, min(o) AS p FROM re GROUP BY 1), nu AS (SELECT c, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INT) AS k FROM pa),
bo AS (SELECT a AS c, min(k) AS k FROM pr JOIN nu ON nu.c = pr.b WHERE a NOT IN (SELECT c FROM co) GROUP BY 1)"""


@query(f"{DBSCAN} SELECT vec_id AS cell_id, coalesce(nu.k, bo.k, -1) AS cluster_id, nu.k IS NOT NULL AS core FROM embeddings LEFT JOIN nu ON nu.c = vec_id LEFT JOIN bo ON bo.c = vec_id")
def dbscan(spark, sf_dir):
    return K.dbscan(clustered(spark, sf_dir)[0], eps=1.15, min_samples=5)


@query()
def leiden(spark, sf_dir):
    return K.leiden(clustered(spark, sf_dir)[0], 0.5, k=10)


@query()
def louvain(spark, sf_dir):
    return K.louvain(clustered(spark, sf_dir)[0], 0.5, k=10)


@query()
def phenograph(spark, sf_dir):
    return K.phenograph(clustered(spark, sf_dir)[0], k=12)


SPARSE = """px AS (SELECT DISTINCT l_linestatus AS mask_id, l_orderkey AS y, unnest(range(l_linenumber * 60, l_linenumber * 60 + CAST(l_quantity AS BIGINT))) AS x FROM lineitem),
ru AS (SELECT mask_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM px) GROUP BY mask_id, y, g),
no AS (SELECT *, row_number() OVER (ORDER BY mask_id, y, x0) AS id FROM ru), ed AS (SELECT a.id AS a, b.id AS b FROM no a JOIN no b ON a.mask_id = b.mask_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
re AS (SELECT id, id AS o FROM no UNION SELECT ed.b, re.o FROM re JOIN ed ON ed.a = re.id), pa AS (SELECT id, min(o) AS p FROM re GROUP BY 1)"""


@query(f"WITH RECURSIVE {SPARSE} SELECT mask_id, y, x0, x1, dense_rank() OVER (PARTITION BY mask_id ORDER BY p) AS label FROM no JOIN pa USING (id)")
def label_components(spark, sf_dir):
    x0 = (F.col("l_linenumber") * 60).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("mask_id"), F.col("l_orderkey").alias("y"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"), F.lit(1).alias("label"))
    return B.connected_components(L.flattened(lines))


EDGE = 64


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an image, a row a vector, in tiles."""

    def pack(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["y"].to_numpy())
        plane = np.array(rows["embedding"].to_pylist(), "<f4")[order]
        ty, h, w = rows["ty"][0].as_py(), *plane.shape
        row = {"image_id": "e", "level": 0, "channel_idx": 0, "ty": ty, "tx": 0, "y0": ty * EDGE, "x0": 0, "h": h, "w": w, "dtype": "float32", "pixels": plane.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("image_id", pa.string()), *((c, pa.int32()) for c in ("level", "channel_idx", "ty", "tx", "y0", "x0", "h", "w")), ("dtype", pa.string()), ("pixels", pa.binary())]))

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.floor(F.col("vec_id") / EDGE).cast("int").alias("ty"), "embedding")
    return rows.groupBy("ty").applyInArrow(pack, "image_id string, level int, channel_idx int, ty int, tx int, y0 int, x0 int, h int, w int, dtype string, pixels binary")


@query("""WITH p AS (SELECT vec_id AS y, CAST(k - 1 AS INT) AS x, embedding[k] AS v FROM embeddings, range(1, 65) r(k)), e AS (SELECT max(y) AS my FROM p),
n AS (SELECT y, x, unnest([y, greatest(y - 1, 0), least(y + 1, my), y, y]) AS ny, unnest([x, x, x, greatest(x - 1, 0), least(x + 1, 63)]) AS nx FROM p, e)
SELECT n.y, n.x, round(median(CAST(p.v AS DOUBLE)), 5) + 0.0 AS value FROM n JOIN p ON p.y = n.ny AND p.x = n.nx GROUP BY 1, 2""")
def tile_median(spark, sf_dir):
    out = I.pixel_values(I.median(embedding_tiles(spark, sf_dir), EDGE, 3))
    return rounded(out.select(F.col("y").cast("long").alias("y"), "x", "value"), 5)


@query("SELECT vec_id AS y, CAST(k - 1 AS INT) AS x, round((CAST(embedding[k] AS DOUBLE) + CAST(embedding[k] AS DOUBLE)) / 2, 5) + 0.0 AS value FROM embeddings, range(1, 65) r(k)")
def tile_merge(spark, sf_dir):
    tiles = embedding_tiles(spark, sf_dir)
    both = tiles.unionByName(tiles.withColumn("channel_idx", F.lit(1)))
    out = I.pixel_values(I.retile(I.merge_channels(both, 0, 1, 2), 48))
    return rounded(out.select(F.col("y").cast("long").alias("y"), "x", "value"), 5)
