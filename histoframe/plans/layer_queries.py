"""More queries over the star tables: cells from tiles, object and mask edits, reports, graphs, files and streams.

They share the stand-ins of `star_queries` and register beside them. Files are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoframe.functions.columns import coverage, in_region_group, yeo_johnson
from histoframe.operators import gating as G
from histoframe.operators import labels as B
from histoframe.operators import measure as M
from histoframe.operators import neighbors as K
from histoframe.operators import regions as R
from histoframe.operators import runs as L
from histoframe.operators import thresholds as T
from histoframe.operators import tiles as I
from histoframe.plans.star_queries import CELLS, CM, DIST, EDGE, OTSU, QUERIES, RUNS, SQL, cell_marker, clustered, embedding_tiles, located, phenotypes, query, rounded, runs, table
from histoframe.scratch import Scratch
from histoframe.sources import catalog, geojson, shapes, tables, zarr_tiles
from histoframe.streaming import incremental

__all__ = ["QUERIES", "SQL"]

# ---- tiles: the embeddings as an image, a row a vector

PIXELS = "p AS (SELECT vec_id AS y, CAST(k - 1 AS INT) AS x, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(k)), e AS (SELECT max(y) AS my FROM p)"
CROSS = "n AS (SELECT y, x, unnest([y, greatest(y - 1, 0), least(y + 1, my), y, y]) AS ny, unnest([x, x, x, greatest(x - 1, 0), least(x + 1, 63)]) AS nx FROM p, e)"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles(spark, sf_dir)


def values(tiles: DataFrame) -> DataFrame:
    return rounded(I.pixel_values(tiles).select(F.col("y").cast("long").alias("y"), "x", "value"), 5)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label tiles on the same grid: cells of 8 by 8 pixels, every fifth one background."""

    def paint(plane, row):
        import numpy as np

        y, x = np.mgrid[row["y0"] : row["y0"] + row["h"], row["x0"] : row["x0"] + row["w"]]
        label = (y // 8) * 8 + x // 8 + 1
        return np.where(label % 5 == 0, 0, label).astype(np.int32)

    return I.map_tiles(image(spark, sf_dir), paint)


@query(f"WITH {PIXELS} SELECT (y // 8) * 8 + x // 8 + 1 AS cell_id, count(*) AS n, round(avg(v), 5) + 0.0 AS mean FROM p WHERE ((y // 8) * 8 + x // 8 + 1) % 5 != 0 GROUP BY 1")
def tile_cell_mean(spark, sf_dir):
    return rounded(I.cell_means_of_tiles(image(spark, sf_dir), blocks(spark, sf_dir)).select("cell_id", "n", "mean"), 5)


@query(f"WITH {PIXELS}, {CROSS}, er AS (SELECT n.y, n.x, min(p.v) AS v FROM n JOIN p ON p.y = ny AND p.x = nx GROUP BY 1, 2) SELECT n.y, n.x, round(max(er.v), 5) + 0.0 AS value FROM n JOIN er ON er.y = ny AND er.x = nx GROUP BY 1, 2")
def tile_opening(spark, sf_dir):
    return values(I.opening(image(spark, sf_dir), EDGE, 3))


@query(f"WITH {PIXELS}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM p), s AS (SELECT y, x, a, least(greatest((v - a) / (b - a), 0), 1) AS s FROM p, q) SELECT y, x, round(CAST(CAST(CASE WHEN a >= 0 THEN s ELSE 2 * s - 1 END AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM s")
def tile_rescale(spark, sf_dir):
    return values(I.rescale(image(spark, sf_dir)))


@query(f"WITH {PIXELS}, q AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.998) AS b FROM p) SELECT y, x, round(CAST(CAST(least(greatest((v - a) / (b - a + 1e-6), 0), 1) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM p, q")
def tile_model_input(spark, sf_dir):
    return values(I.normalize_input(image(spark, sf_dir)))


@query(f"WITH {PIXELS} SELECT '0' AS channel, round(min(v), 6) AS data_min, round(max(v), 6) AS data_max FROM p")
def tile_range(spark, sf_dir):
    found = I.pixel_values(image(spark, sf_dir)).withColumn("channel", F.col("channel_idx").cast("string"))
    return rounded(M.value_range(found, "channel"))


GROWN = """lab AS (SELECT y, x, CASE WHEN y % 12 = 5 AND x % 16 = 7 THEN (y // 12) * 4 + x // 16 + 1 ELSE 0 END AS label FROM p),
o AS (SELECT * FROM (SELECT CAST(a.range AS BIGINT) AS dy, CAST(b.range AS INT) AS dx, a.range * a.range + b.range * b.range AS d FROM range(-4, 5) a, range(-4, 5) b) WHERE d <= 16),
gr AS (SELECT l.y + dy AS y, l.x + dx AS x, label, d FROM lab l, o WHERE label > 0), grown AS (SELECT y, x, arg_min(label, d * 1000000 + label) AS label FROM gr JOIN p USING (y, x) GROUP BY 1, 2)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def paint(plane, row):
        import numpy as np

        y, x = np.mgrid[row["y0"] : row["y0"] + row["h"], row["x0"] : row["x0"] + row["w"]]
        return np.where((y % 12 == 5) & (x % 16 == 7), (y // 12) * 4 + x // 16 + 1, 0).astype(np.int32)

    return I.map_tiles(image(spark, sf_dir), paint)


@query(f"WITH {PIXELS}, {GROWN} SELECT y, x, CAST(label AS BIGINT) AS label FROM grown")
def tile_expand(spark, sf_dir):
    grown = I.pixel_values(B.expand_labels(seeds(spark, sf_dir), EDGE, 4)).where("value > 0")
    return grown.select(F.col("y").cast("long").alias("y"), "x", F.col("value").cast("long").alias("label"))


@query(f"WITH {PIXELS}, {GROWN} SELECT 'm' AS mask_id, CAST(label AS BIGINT) AS cell_id, count(*) AS area_px, min(y) AS ymin, CAST(max(x) + 1 AS INT) AS xmax FROM grown GROUP BY 2")
def tile_label_runs(spark, sf_dir):
    cells = M.cell_geometry(B.label_runs(B.expand_labels(seeds(spark, sf_dir), EDGE, 4), "m"))
    return cells.select("mask_id", "cell_id", "area_px", F.col("ymin").cast("long").alias("ymin"), F.col("xmax").cast("int").alias("xmax"))


@query(f"WITH {PIXELS}, {GROWN} SELECT 'm' AS mask_id, CAST(label AS BIGINT) AS cell_id, count(*) AS area_px FROM grown GROUP BY 2 HAVING min(y) > 2 AND max(y) < 399 AND min(x) > 3 AND max(x) + 1 < 60")
def drop_border(spark, sf_dir):
    kept = B.drop_border(B.label_runs(B.expand_labels(seeds(spark, sf_dir), EDGE, 4), "m"), (2, 3, 400, 60))
    return M.cell_geometry(kept).select("mask_id", "cell_id", "area_px")


@query(f"WITH {PIXELS} SELECT y, x, round(v, 5) + 0.0 AS value FROM p WHERE y >= 10 AND y < 300 AND x >= 5 AND x < 40")
def window_read(spark, sf_dir):
    return values(zarr_tiles.read_window(image(spark, sf_dir), 0, 10, 300, 5, 40, EDGE))


@query(f"WITH {PIXELS} SELECT y, x, round(v, 5) + 0.0 AS value FROM p WHERE y % 3 = 0 AND x % 3 = 0")
def stride_sample(spark, sf_dir):
    rows = I.pixel_values(image(spark, sf_dir))
    return rounded(M.stride_sample(rows, 900, 100).select(F.col("y").cast("long").alias("y"), "x", "value"), 5)


@query(f"WITH {PIXELS}, g AS (SELECT my + 1 AS h, CAST(floor((my + 1) / 2) AS BIGINT) AS nh FROM e), o AS (SELECT a.y AS ny, CAST(b.range AS INT) AS nx, h, nh FROM g, (SELECT DISTINCT y FROM p) a, range(0, 48) b WHERE a.y < nh) SELECT ny AS y, nx AS x, round(v, 5) + 0.0 AS value FROM o JOIN p ON p.y = floor(ny * h / nh) AND p.x = floor(nx * 64 / 48)")
def resize_nearest(spark, sf_dir):
    rows = I.pixel_values(image(spark, sf_dir))
    height = rows.agg(F.max("y")).first()[0] + 1
    return rounded(I.resize_nearest(rows, height, 64, height // 2, 48).select(F.col("y").cast("long").alias("y"), F.col("x").cast("int").alias("x"), "value"), 5)


@query(f"WITH {PIXELS} SELECT y, x, round(v, 5) + 0.0 AS value FROM p")
def zarr_round_trip(spark, sf_dir):
    tiles = image(spark, sf_dir)
    store = Scratch(spark, "zarr").folder("store")
    height = I.pixel_values(tiles).agg(F.max("y")).first()[0] + 1
    zarr_tiles.write_zarr_tiles(tiles, store, "images/e/0", (1, height, 64), EDGE, "float32")
    return values(zarr_tiles.read_tiles(spark, store, "images/e/0"))


BRIGHT = f"""WITH RECURSIVE {PIXELS}, px AS (SELECT y, x FROM p WHERE CAST(v AS FLOAT) > CAST(0.15 AS FLOAT)), ru AS (SELECT y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM px) GROUP BY y, g),
no AS (SELECT *, row_number() OVER (ORDER BY y, x0) AS id FROM ru), ed AS (SELECT a.id AS a, b.id AS b FROM no a JOIN no b ON abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
re AS (SELECT id, id AS o FROM no UNION SELECT ed.b, re.o FROM re JOIN ed ON ed.a = re.id), pa AS (SELECT id, min(o) AS first FROM re GROUP BY 1)"""


@query(f"{BRIGHT} SELECT unnest([16, 64]) AS edge, y, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, dense_rank() OVER (ORDER BY first) AS label FROM no JOIN pa USING (id)")
def tile_components(spark, sf_dir):
    """Parts of the bright pixels, found in tiles of two sizes."""
    import numpy as np

    tiles = image(spark, sf_dir)
    out = None
    for edge in (16, 64):
        bright = I.map_tiles(I.retile(tiles, edge), lambda p, _: (p > np.float32(0.15)).astype(np.uint8))
        found = B.components_of_tiles(bright, "bright").select(F.lit(edge).alias("edge"), "y", "x0", "x1", "label")
        out = found if out is None else out.unionByName(found)
    return out


MIRROR = "CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} > {m} THEN 2 * {m} + 1 - {i} ELSE {i} END"
BLUR = f"""k AS (SELECT k, w / sum(w) OVER () AS w FROM (SELECT range AS k, exp(-0.5 * (range / 0.5) * (range / 0.5)) AS w FROM range(-2, 3))),
gy AS (SELECT a.y, a.x, sum(k.w * b.v) AS v FROM (SELECT p.y, p.x, k.k, my FROM p, k, e) a JOIN k USING (k) JOIN p b ON b.x = a.x AND b.y = {MIRROR.format(i="(a.y + a.k)", m="a.my")} GROUP BY 1, 2),
g AS (SELECT a.y, a.x, sum(k.w * b.v) AS v FROM (SELECT gy.y, gy.x, k.k FROM gy, k) a JOIN k USING (k) JOIN gy b ON b.y = a.y AND b.x = {MIRROR.format(i="(a.x + a.k)", m="63")} GROUP BY 1, 2)"""


@query(f"WITH {PIXELS}, {BLUR}, n AS (SELECT y, x, unnest([y, greatest(y - 1, 0), least(y + 1, my), y, y]) AS ny, unnest([x, x, x, greatest(x - 1, 0), least(x + 1, 63)]) AS nx, unnest([5, -1, -1, -1, -1]) AS w FROM g, e) SELECT n.y, n.x, round(CAST(CAST(sum(n.w * g.v) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM n JOIN g ON g.y = n.ny AND g.x = n.nx GROUP BY 1, 2")
def tile_edge_enhance(spark, sf_dir):
    found = I.pixel_values(I.edge_enhance(image(spark, sf_dir), EDGE, 0.5))
    return rounded(found.select(F.col("y").cast("long").alias("y"), "x", "value"), 5)


COMPOSITE = "s AS (SELECT y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM p), c AS (SELECT y, x, 0.8 * least(greatest((least(greatest((v + 0.3) / 0.6, 0), 1) - 0.25) / 0.5, 0), 1) AS a, 1.0 * least(greatest((least(greatest((0.3 - v) / 0.6, 0), 1) - 0.0) / 1.0, 0), 1) AS b FROM s), sum3 AS (SELECT y, x, (a * 1.0 + b * 0.0) * 1.5 / 2 AS r, (a * 0.5 + b * 0.25) * 1.5 / 2 AS g, (a * 0.0 + b * 1.0) * 1.5 / 2 AS b FROM c)"
CLIPPED = ", ".join(f"CAST(floor(least(greatest({c}, 0), 1) * 255) AS INT) AS {c}" for c in "rgb")


def _composite(spark, sf_dir, overlays=None):
    """Two channels of two colours, the second one the first turned round, as a row a pixel."""
    import numpy as np
    import pyarrow as pa

    tiles = image(spark, sf_dir)
    other = I.map_tiles(tiles.withColumn("channel_idx", F.lit(1)), lambda p, _: -p)
    colours = spark.createDataFrame([(0, 1.0, 0.5, 0.0, -0.3, 0.3, 0.25, 0.75, 0.8), (1, 0.0, 0.25, 1.0, -0.3, 0.3, 0.0, 1.0, 1.0)], "channel_idx int, r double, g double, b double, data_min double, data_max double, range_min double, range_max double, alpha double")
    painted = I.composite_rgb(tiles.unionByName(other), colours, 1.5, overlays)

    def pixels(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rgb = np.frombuffer(row["rgb"], np.uint8).reshape(row["h"], row["w"], 3).astype(np.int32)
                y, x = np.mgrid[0 : row["h"], 0 : row["w"]]
                columns = [pa.array((y + row["ty"] * EDGE).ravel().astype(np.int64)), pa.array((x + row["tx"] * EDGE).ravel().astype(np.int32)), *(pa.array(rgb[:, :, k].ravel()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["y", "x", "r", "g", "b"])

    return painted.mapInArrow(pixels, "y long, x int, r int, g int, b int")


@query(f"WITH {PIXELS}, {COMPOSITE} SELECT y, x, {CLIPPED} FROM sum3")
def tile_composite(spark, sf_dir):
    return _composite(spark, sf_dir)


MASKED = ", ".join(f"CASE WHEN label % 5 = 0 THEN {c} ELSE (1 - 0.5) * {c} + 0.5 * (label * {x}e0 - floor(label * {x}e0)) END AS {c}" for c, x in zip("rgb", ("0.6180339887", "0.7548776662", "0.569840291")))
CALLED = ", ".join(f"CASE WHEN mean IS NULL THEN {c} ELSE (1 - 0.25) * {c} + 0.25 * {v} END AS {c}" for c, v in (("r", "CASE WHEN mean > 0.01 THEN 0 ELSE 1 END"), ("g", "CASE WHEN mean > 0.01 THEN 1 ELSE 0 END"), ("b", "0")))


@query(f"""WITH {PIXELS}, {COMPOSITE}, l AS (SELECT *, (y // 8) * 8 + x // 8 + 1 AS label FROM sum3), m AS (SELECT y, x, label, {MASKED} FROM l),
k AS (SELECT (y // 8) * 8 + x // 8 + 1 AS label, avg(v) AS mean FROM p WHERE ((y // 8) * 8 + x // 8 + 1) % 5 != 0 GROUP BY 1), n AS (SELECT m.y, m.x, {CALLED} FROM m LEFT JOIN k ON k.label = m.label) SELECT y, x, {CLIPPED} FROM n""")
def tile_overlays(spark, sf_dir):
    """Cells in colours of their own over the composite, and over both whether their mean is high (green) or low (red)."""
    labels = blocks(spark, sf_dir)
    layers = spark.createDataFrame([("outline", "mask", 0.5), ("called", "cell", 0.25)], "layer string, kind string, opacity double")
    both = labels.withColumn("layer", F.lit("outline")).unionByName(labels.withColumn("layer", F.lit("called")))
    high = (F.col("mean") > 0.01).cast("double")
    means = I.cell_means_of_tiles(image(spark, sf_dir), labels)
    colours = means.select("image_id", F.lit("called").alias("layer"), "cell_id", (1 - high).alias("r"), high.alias("g"), F.lit(0.0).alias("b"))
    return _composite(spark, sf_dir, I.overlay_tiles(both, layers, colours))


@query(f"WITH {PIXELS} SELECT CAST(y // 16 AS INT) AS ty, x // 16 AS tx, count(*) AS n FROM p GROUP BY 1, 2 HAVING min(y) < 200 AND max(y) + 1 > 70 AND min(x) < 33 AND max(x) + 1 > 20")
def crop_to_region(spark, sf_dir):
    """Tiles that segmentation of a window has to read."""
    return B.crop_to_region(I.retile(image(spark, sf_dir), 16), (70, 20, 200, 33)).select("ty", "tx", (F.col("h") * F.col("w")).cast("long").alias("n"))


@query()
def tile_voronoi(spark, sf_dir):
    """Seeded flooding of the embeddings' image."""
    found = B.label_voronoi_otsu(image(spark, sf_dir), EDGE, 1, 1, 31)
    return I.pixel_values(found).where("value > 0").groupBy(F.col("value").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query()
def tile_expand_separated(spark, sf_dir):
    """Single pixels grown until they touch, with a line between them."""
    found = B.expand_separated(seeds(spark, sf_dir), EDGE, 9)
    return I.pixel_values(found).where("value > 0").groupBy(F.col("value").cast("long").alias("label")).agg(F.count("*").alias("n"))


# ---- masks and cells


@query(f"WITH {RUNS} SELECT mask_id, y, x0, x1, label % 100 AS label FROM runs WHERE label % 100 > 0")
def remap_labels(spark, sf_dir):
    own = runs(spark, sf_dir)
    return L.remap_labels(own, own.select("label").distinct().withColumn("new_label", F.col("label") % 100))


@query(f"WITH {RUNS} SELECT mask_id, y, x0, x1, 1 AS label FROM runs WHERE label IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'P')")
def mask_of_type(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1).alias("cell_id"))
    return L.mask_of(runs(spark, sf_dir), chosen)


@query(f"WITH {RUNS}, a AS (SELECT mask_id, label, sum(x1 - x0) AS area FROM runs GROUP BY 1, 2) SELECT mask_id, label AS cell_id, CAST(area AS BIGINT) AS area_px, round(area * 0.25, 6) AS area_um2 FROM a")
def cell_microns(spark, sf_dir):
    return rounded(M.to_microns(M.cell_geometry(runs(spark, sf_dir)), 0.5).select("mask_id", "cell_id", "area_px", "area_um2"))


@query(f"""WITH {RUNS}, pt AS (SELECT mask_id, y // 20 AS wy, wx, label, sum(least(x1, (wx + 1) * 20) - greatest(x0, wx * 20)) AS a FROM (SELECT *, unnest(range(x0 // 20, (x1 - 1) // 20 + 1)) AS wx FROM runs WHERE x1 > x0) GROUP BY 1, 2, 3, 4),
st AS (SELECT wy, wx, mask_id, count(*) + 1 AS n_labels, median(a) AS median_area, stddev_pop(a) / sqrt(count(*)) AS s FROM pt GROUP BY 1, 2, 3)
SELECT wy, wx, mask_id, n_labels, round(median_area, 6) AS median_area, round(CASE WHEN s > 0 AND ln(s) + 1 != 0 THEN 1 / (ln(s) + 1) ELSE 0 END, 4) + 0.0 AS evenness FROM st""")
def window_stats(spark, sf_dir):
    out = L.window_stats(runs(spark, sf_dir), 20)
    return out.select("wy", "wx", "mask_id", "n_labels", F.round("median_area", 6).alias("median_area"), (F.round("evenness", 4) + 0.0).alias("evenness"))


@query(f"""WITH {RUNS}, old AS (SELECT * FROM runs WHERE mask_id = 'F'), px AS (SELECT y, unnest(range(x0, x1)) AS x FROM old), nw AS (SELECT y, unnest(range(x0, x1)) AS x, label + (SELECT max(label) FROM old) AS label FROM runs WHERE mask_id = 'O')
SELECT (SELECT sum(x1 - x0) FROM old) + (SELECT count(*) FROM nw ANTI JOIN px USING (y, x)) AS pixels, (SELECT sum((x1 - x0) * label) FROM old) + (SELECT sum(label) FROM nw ANTI JOIN px USING (y, x)) AS label_sum""")
def replace_in_gaps(spark, sf_dir):
    own = runs(spark, sf_dir)
    out = L.replace_in_region(own.where("mask_id = 'F'"), own.where("mask_id = 'O'"))
    n = F.col("x1") - F.col("x0")
    return out.agg(F.sum(n).alias("pixels"), F.sum(n * F.col("label")).alias("label_sum")).select(F.col("pixels").cast("decimal(38,0)"), F.col("label_sum").cast("decimal(38,0)"))


@query(f"WITH {RUNS} SELECT mask_id, label FROM runs WHERE y = 3 AND x0 <= 700 AND x1 > 700")
def probe(spark, sf_dir):
    at = spark.createDataFrame([(700, 3, "view", 1.0)], "x int, y int, marker string, value double")
    return M.probe(at, runs(spark, sf_dir), 700, 3, "view").where("mask_id is not null").select("mask_id", "label")


NEAR = f"{CELLS}, nc AS (SELECT CASE WHEN cell_id % 2 = 0 THEN 'A' ELSE 'B' END AS mask_id, cell_id, x, y, cell_id % 13 + 1 AS area FROM cells)"


@query(f"WITH {NEAR} SELECT a.mask_id AS a_mask, a.cell_id AS a, b.mask_id AS b_mask, b.cell_id AS b FROM nc a JOIN nc b ON a.mask_id != b.mask_id AND abs(a.x - b.x) < sqrt(a.area / 3.141592653589793) AND abs(a.y - b.y) < sqrt(a.area / 3.141592653589793)")
def near_cells(spark, sf_dir):
    cells = located(spark, sf_dir)
    return L.near_cells(cells.select(F.when(F.col("cell_id") % 2 == 0, "A").otherwise("B").alias("mask_id"), "cell_id", "x_px", "y_px", (F.col("cell_id") % 13 + 1).alias("area_px")))


@query(f"WITH {CELLS}, c AS (SELECT *, unnest([floor(x / 32) - 1, floor(x / 32), floor(x / 32) + 1]) AS tx FROM cells) SELECT cell_id, CAST(tx AS BIGINT) AS tx, CAST(floor(y / 32) AS BIGINT) AS ty FROM c WHERE floor(x / 32) = tx")
def owned_objects(spark, sf_dir):
    cells = located(spark, sf_dir).withColumns({"ty": F.floor(F.col("y_px") / 32), "tx": F.explode(F.sequence(F.floor(F.col("x_px") / 32) - 1, F.floor(F.col("x_px") / 32) + 1))})
    return B.owned(cells, 32).select("cell_id", "tx", "ty")


# ---- channels, display and names


KINDS = "ch AS (SELECT p_partkey AS channel_idx, p_brand AS name, CASE p_type WHEN 'ECONOMY' THEN 'original' WHEN 'PROMO' THEN 'derived' WHEN 'SMALL' THEN 'mask' WHEN 'LARGE' THEN 'type_mask' ELSE 'region' END AS kind FROM part)"


@query(f"WITH {KINDS} SELECT kind, count(*) FILTER (kind = 'original') AS raw, count(*) FILTER (kind NOT IN ('mask', 'cell_mask', 'type_mask', 'region') AND channel_idx >= 0) AS ai, count(*) FILTER (kind IN ('original', 'derived')) AS clustered, count(*) FILTER (kind NOT IN ('mask', 'cell_mask', 'type_mask', 'region')) AS ruled FROM ch GROUP BY 1")
def channel_kinds(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "original").when(F.col("p_type") == "PROMO", "derived").when(F.col("p_type") == "SMALL", "mask").when(F.col("p_type") == "LARGE", "type_mask").otherwise("region")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel_idx"), F.col("p_brand").alias("name"), kind.alias("kind"))
    sets = {"raw": M.raw_markers(rows), "ai": M.ai_markers(rows), "clustered": M.cluster_channels(rows), "ruled": M.rule_markers(rows)}
    out = rows.select("kind").distinct()
    for name, found in sets.items():
        out = out.join(found.groupBy("kind").agg(F.count("*").alias(name)), "kind", "left")
    return out.fillna(0)


@query("SELECT event_id, round(least(1, greatest(0, (least(1, greatest(0, (value - 10) / 80.0)) - 0.2) / 0.5)), 6) AS share FROM events")
def display_coverage(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", coverage(F.col("value").cast("double"), F.lit(10.0), F.lit(90.0), F.lit(0.2), F.lit(0.7)).alias("share")))


@query("SELECT c_custkey AS cell_id, r_name IN ('ASIA') AS in_group FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def region_group(spark, sf_dir):
    cells = located(spark, sf_dir)
    return cells.select("cell_id", in_region_group(F.concat_ws(" ", "region", F.col("cell_id").cast("string")), "asia").alias("in_group"))


@query("SELECT CAST(p_partkey AS INT) AS ord, CASE p_type WHEN 'ECONOMY' THEN 'cell_mask' WHEN 'PROMO' THEN 'type_mask' ELSE 'mask' END AS kind, p_brand AS name FROM part")
def layer_names(spark, sf_dir):
    head = F.when(F.col("p_type") == "ECONOMY", "Cell: ").when(F.col("p_type") == "PROMO", "Type:").otherwise("")
    return catalog.classify_layers(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("ord"), F.concat(head, "p_brand").alias("name")))


@query("SELECT o_orderpriority AS image_id, CAST(greatest(coalesce(min(lv) FILTER (w / bw < 0.375) - 1, max(lv)), 0) AS INT) AS level FROM (SELECT o_orderpriority, CAST(o_orderkey % 7 AS INT) AS lv, 4096 // (o_orderkey % 7 + 1) AS w, max(4096 // (o_orderkey % 7 + 1)) OVER (PARTITION BY o_orderpriority) AS bw FROM orders) GROUP BY 1")
def level_choice(spark, sf_dir):
    level = (F.col("o_orderkey") % 7).cast("int")
    arrays = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("image_id"), level.alias("level"), F.floor(F.lit(4096) / (level + 1)).alias("width")).distinct()
    return catalog.select_level(catalog.levels(arrays), 0.5)


# ---- normalisation and graphs


@query(f"WITH {CM}, v AS (SELECT cell_id, marker, CASE WHEN mean >= 0 THEN (pow(mean + 1, 0.3) - 1) / 0.3 ELSE -(pow(1 - mean, 1.7) - 1) / 1.7 END AS v FROM cm) SELECT cell_id, marker, round(v, 6) AS value FROM v")
def yeo_johnson_given(spark, sf_dir):
    return rounded(cell_marker(spark, sf_dir).select("cell_id", "marker", yeo_johnson(F.col("mean"), F.lit(0.3)).alias("value")))


KNN = f"nb AS (SELECT cell_id, neighbor FROM (SELECT a.vec_id AS cell_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id) WHERE k <= 6), eg AS (SELECT DISTINCT least(cell_id, neighbor) AS a, greatest(cell_id, neighbor) AS b FROM nb)"


@query(f"WITH {KNN} SELECT a, b, CAST(1 AS DOUBLE) AS w FROM eg")
def neighbor_graph(spark, sf_dir):
    return K.neighbor_graph(K.knn(clustered(spark, sf_dir)[0], 6))


@query(f"WITH {KNN}, sh AS (SELECT eg.a, eg.b, count(*) AS s FROM eg JOIN nb x ON x.cell_id = eg.a JOIN nb y ON y.cell_id = eg.b AND y.neighbor = x.neighbor GROUP BY 1, 2) SELECT a, b, round(s / (12 - s), 6) AS w FROM sh")
def jaccard_graph(spark, sf_dir):
    return rounded(K.jaccard_graph(K.knn(clustered(spark, sf_dir)[0], 6)))


@query(f"SELECT round(quantile_cont(d, 0.9), 6) AS eps FROM (SELECT a.vec_id, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON true) WHERE k = 10")
def auto_eps(spark, sf_dir):
    far = K.knn(clustered(spark, sf_dir)[0], 10, include_self=True).where("rank = 10")
    return rounded(K.far_end(far).withColumnRenamed("e", "eps"))


# ---- rules and reports


EDITED = [(0, "shopper", "purchase", 1), (1, "viewer", "view", 2), (1, "viewer", "purchase", 2)]


@query(f"""WITH {OTSU}, pos2 AS (SELECT cell_id, marker, CASE WHEN mean >= threshold THEN 2 ELSE 1 END AS state FROM cm JOIN thr USING (marker)), rules(type_ord, cell_type, marker, required) AS (VALUES {", ".join(f"({o}, '{t}', '{m}', {q})" for o, t, m, q in EDITED)}, (0, 'shopper', 'error', 2)),
typed AS (SELECT cell_id, cell_type FROM pos2 JOIN rules USING (marker) WHERE (required = 1) = (state = 2) GROUP BY cell_id, cell_type HAVING count(*) = 2) SELECT cell_id, cell_type FROM typed""")
def gating_edited(spark, sf_dir):
    rules = G.delete_type(G.rename(phenotypes(spark), "cell_type", {"buyer": "shopper"}), "noisy")
    rules = G.reorder_types(G.cycle_rule(rules, "viewer", "view"), ["viewer", "shopper"])
    cm = cell_marker(spark, sf_dir)
    return G.gate(G.positivity(cm, T.otsu(cm)), rules, unknown=False).select("cell_id", "cell_type")


SCORED = f"""{CELLS}, mc AS (SELECT *, CASE WHEN cell_id % 2 = 0 THEN 'AI' ELSE 'Otsu' END AS method FROM cells), nn AS (SELECT method, count(*) FILTER (region = 'ASIA') AS na, count(*) FILTER (region = 'EUROPE') AS nb FROM mc GROUP BY 1),
pp AS (SELECT method, cell_type, count(*) FILTER (region = 'ASIA') / any_value(na) AS p, count(*) FILTER (region = 'EUROPE') / any_value(nb) AS q FROM mc JOIN nn USING (method) GROUP BY 1, 2), sc AS (SELECT method, cell_type, (p - q) * (p - q) / (p * (1 - p) + q * (1 - q)) AS j FROM pp)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = located(spark, sf_dir)
    both = {m: cells.where(F.col("cell_id") % 2 == k) for k, m in enumerate(("AI", "Otsu"))}
    a, b = (R.fisher(own, own, "ASIA", "EUROPE").withColumn("method", F.lit(m)) for m, own in both.items())
    return a.unionByName(b)


@query(f"WITH {SCORED} SELECT method, round(avg(j), 6) AS mean, round(median(j), 6) AS median, CAST(0 AS BIGINT) AS n_infinite, count(*) AS n_types FROM sc GROUP BY 1")
def separation_summary(spark, sf_dir):
    return rounded(R.separation_summary(scored(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT cell_type, arg_max(method, j) AS method, round(max(j), 6) AS separation FROM sc GROUP BY 1")
def better_method(spark, sf_dir):
    return rounded(R.better_method(scored(spark, sf_dir)))


# ---- files written and read back


@query("SELECT c_custkey AS cell_id, CAST(c_custkey % 100 AS DOUBLE) AS x_px, c_mktsegment AS cell_type FROM customer")
def cells_written(spark, sf_dir):
    path = Scratch(spark, "cells").path("cells")
    tables.write_cells(located(spark, sf_dir).select("cell_id", "x_px", "cell_type", "region"), path, "region")
    return spark.read.parquet(path).select("cell_id", "x_px", "cell_type")


@query(f"WITH {CM} SELECT cell_id, marker, round(mean, 6) AS value FROM cm")
def bundle_written(spark, sf_dir):
    path, cm = Scratch(spark, "bundle").path("bundle"), cell_marker(spark, sf_dir)
    cells = cm.select("cell_id").distinct().select("cell_id", (F.col("cell_id") * 1.0).alias("x_px"), F.lit(0.0).alias("y_px"))
    tables.write_cell_bundle(cells, cm, path)
    return rounded(spark.read.parquet(f"{path}/X"))


@query("SELECT o_orderstatus AS state, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1")
def results_written(spark, sf_dir):
    path = Scratch(spark, "results").path("out")
    tables.write_results({"states": table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))}, path)
    return spark.read.csv(f"{path}/states", header=True)


RULED = "ru AS (SELECT p_brand AS marker, p_type AS cell_type, CAST(count(*) % 3 AS INT) AS required FROM part GROUP BY 1, 2)"


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("marker"), F.col("p_type").alias("cell_type")).agg((F.count("*") % 3).cast("int").alias("required"))
    return counts.withColumn("type_ord", F.ascii("cell_type"))


@query(f"WITH {RULED}, g AS (SELECT * FROM (SELECT DISTINCT marker FROM ru) CROSS JOIN (SELECT DISTINCT cell_type FROM ru)) SELECT cell_type, marker, coalesce(required, 0) AS required FROM g LEFT JOIN ru USING (marker, cell_type) WHERE marker != 'Brand#1'")
def rules_written(spark, sf_dir):
    path = Scratch(spark, "rules").path("rules")
    rules = part_rules(spark, sf_dir)
    tables.write_rules(rules, path)
    known = rules.select(F.col("marker").alias("name")).where("name <> 'Brand#1'").distinct()
    return tables.read_rules(spark, path, known)[0].select("cell_type", "marker", "required")


@query("SELECT p_brand AS marker FROM part WHERE p_brand != 'Brand#1' GROUP BY 1")
def rules_ignored(spark, sf_dir):
    path = Scratch(spark, "rules").path("rules")
    tables.write_rules(part_rules(spark, sf_dir), path)
    known = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).where("name = 'Brand#1'").distinct()
    return tables.read_rules(spark, path, known)[1]


@query("SELECT CAST(p_partkey AS INT) AS ord, p_brand AS name, p_type AS kind FROM part")
def session_written(spark, sf_dir):
    path = Scratch(spark, "session").path("session")
    catalog.write_session(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("ord"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind")), path)
    return catalog.read_session(spark, path)


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for every supplier, at its key, as large as its nation's number and one."""
    x, n = F.col("s_suppkey").cast("double"), (F.col("s_nationkey") + 1).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, F.lit(0.0)), point(x + n, F.lit(0.0)), point(x + n, n), point(x, n))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), "s_suppkey").alias("name"), F.lit(1).alias("part"), ring.alias("ring"))


SQUARES = "SELECT 'Supplier ' || s_suppkey AS name, CAST(s_suppkey AS DOUBLE) AS x0, CAST(s_suppkey + s_nationkey + 1 AS DOUBLE) AS x1, CAST(s_nationkey + 1 AS DOUBLE) AS y1, 4 AS points FROM supplier"


@query(SQUARES)
def geojson_round_trip(spark, sf_dir):
    path = Scratch(spark, "geojson").path("regions")
    lines = geojson.features_json(squares(spark, sf_dir)).select("value")
    whole = lines.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value"))  # one document, as the format asks
    whole.write.mode("overwrite").text(path)
    found = geojson.read_geojson_regions(spark, path)
    return found.select("name", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"), F.size("ring").alias("points"))


@query(SQUARES)
def shapes_round_trip(spark, sf_dir):
    path = Scratch(spark, "shapes").folder("shapes")
    shapes.write_shapes(squares(spark, sf_dir), path)
    found = shapes.read_shapes(spark, path)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return found.select("name", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.size("ring").alias("points"))


@query("SELECT 'Supplier ' || s_suppkey AS region, CAST(least(s_suppkey + s_nationkey + 1, 60) AS DOUBLE) AS x1, CAST(least(s_nationkey + 1, 9) AS DOUBLE) AS y1 FROM supplier WHERE s_suppkey <= 60")
def regions_prepared(spark, sf_dir):
    rings = squares(spark, sf_dir).select(F.col("name").alias("region"), "ring")
    found = R.prepare_regions(rings, 0.1, 60.0, 9.0)
    return found.select("region", F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS image_id, user_id + 1 AS cell_id, event_type AS marker, count(*) AS n, round(sum(value), 5) AS sum, max(value) AS max FROM events GROUP BY 1, 2, 3")
def streamed_cells(spark, sf_dir):
    """Readings of two images, each tile's in several files, a file a micro-batch; an older version of all comes too."""
    scratch = Scratch(spark, "stream")
    image_id = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("image_id")
    place = [F.floor(F.col("user_id") / 2 % 4).cast("int").alias("ty"), F.lit(0).alias("tx")]
    rows = table(spark, sf_dir, "events").select(image_id, *place, F.lit(2).cast("long").alias("version"), F.lit(None).cast("int").alias("part"), (F.col("user_id") + 1).alias("cell_id"), F.col("event_type").alias("marker"), F.col("value").cast("double").alias("value"))
    older = rows.withColumns({"version": F.lit(1).cast("long"), "value": F.col("value") + 1})
    rows.repartition(4).write.parquet(scratch.path("in"))
    older.coalesce(1).write.mode("append").parquet(scratch.path("in"))
    stream = spark.readStream.schema(incremental.SCHEMA).option("maxFilesPerTrigger", 1).parquet(scratch.path("in"))
    incremental.incremental_cell_stats(stream, scratch.path("out"), scratch.path("check"), once=True, compact_every=2).awaitTermination()
    out = incremental.cell_statistics(spark, scratch.path("out"))
    return out.select("image_id", "cell_id", "marker", "n", F.round("sum", 5).alias("sum"), "max")


@query("SELECT 'S' || (o_custkey % 3) AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'AI' ELSE 'Otsu' END AS method, o_orderstatus AS cell_type, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def projects_compared(spark, sf_dir):
    """Cell tables of six project stores, read in one scan with sample and method from the stores' names."""
    root = Scratch(spark, "projects").path("stores")
    cells = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 3).alias("s"), F.when(F.col("o_orderkey") % 2 == 0, "AI").otherwise("Otsu").alias("m"), F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("cell_type"))
    for sample in ("S0", "S1", "S2"):
        for method in ("AI", "Otsu"):
            tables.write_cells(cells.where((F.col("s") == sample) & (F.col("m") == method)).select("cell_id", "cell_type"), f"{root}/{sample}_{method}.zarr/cells")
    return tables.read_projects(spark, f"{root}/*/cells").groupBy("sample", "method", "cell_type").agg(F.count("*").alias("n"))
