"""Hand-made cases and brute force for masks, regions, tiles, labels, clusters and sources."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from histoframe.functions.columns import coverage, in_ring, safe_names
from histoframe.operators import clusters as C
from histoframe.operators import flooding
from histoframe.operators import gating as G
from histoframe.operators import labels as B
from histoframe.operators import linkage as linkage_module
from histoframe.operators import measure as M
from histoframe.operators import neighbors as K
from histoframe.operators import normalize as N
from histoframe.operators import parts, ranks
from histoframe.operators.fusion import fuse_masks
from histoframe.operators import regions as R
from histoframe.operators import runs as L
from histoframe.operators import thresholds as T
from histoframe.operators import tiles as I
from histoframe.sources import catalog, geojson, project, shapes, tables, zarr_tiles
from histoframe.scratch import Scratch
from histoframe.streaming import incremental

RUN = "mask_id string, y long, x0 long, x1 long, label long"


def runs_of(spark, *masks):
    """Rows of runs from (name, array) pairs."""
    rows = []
    for name, plane in masks:
        for y in range(plane.shape[0]):
            x = 0
            while x < plane.shape[1]:
                if plane[y, x]:
                    a = x
                    while x < plane.shape[1] and plane[y, x] == plane[y, a]:
                        x += 1
                    rows.append((name, y, a, x, int(plane[y, a])))
                else:
                    x += 1
    return spark.createDataFrame(rows, RUN)


def plane_from(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        assert not out[r.y, r.x0 : r.x1].any()
        out[r.y, r.x0 : r.x1] = r.label
    return out


def tiles_of(spark, plane, edge, channel=0):
    rows = []
    for y in range(0, plane.shape[0], edge):
        for x in range(0, plane.shape[1], edge):
            p = np.ascontiguousarray(plane[y : y + edge, x : x + edge])
            rows.append(("a", 0, channel, y // edge, x // edge, y, x, *p.shape, p.dtype.name, bytearray(p.tobytes())))
    return spark.createDataFrame(rows, zarr_tiles.SCHEMA)


def image_from(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.pixels, r.dtype).reshape(r.h, r.w)
    return out


def plain_best(cuts, merit, options):
    """The best of masks, arrays cut to one window, by the merit; the first of equals."""
    def spread(a):
        areas = np.unique(a[a > 0], return_counts=True)[1]
        sd = areas.std() / np.sqrt(len(areas)) if len(areas) else 0
        return 1 / (np.log(sd) + 1) if sd > 0 and np.log(sd) != -1 else 0.0

    if merit == "j1":
        fg = [c > 0 for c in cuts]
        table = np.array([[(a & b).sum() / max((a | b).sum(), 1) for b in fg] for a in fg])
        worst = int(np.argmin(table.sum(1)))
        rest = table.copy()
        rest[worst], rest[:, worst] = 0, 0
        sums = rest.sum(1)
        return int(np.argmax(sums)) if sums.max() > 1 else int(np.flatnonzero(sums == 0)[0])
    scores = {k: spread(cuts[k]) if merit == "cstd" else len(np.unique(cuts[k][cuts[k] > 0])) for k in options}
    return max(options, key=lambda k: (scores[k], -k))


def plain_fusion(masks, merit, n):
    """Pixel by pixel: (fused labels, mask of each painted pixel or -1)."""
    height, width = masks[0].shape
    cells = []  # mask, label, y, x, area, first pixel
    for k, m in enumerate(masks):
        for label in np.unique(m[m > 0]):
            ys, xs = np.nonzero(m == label)
            cells.append((k, int(label), ys.mean(), xs.mean(), len(ys), (ys[0], xs[0])))
    grace = np.ceil(np.percentile([c[4] for c in cells], 32) * 0.05)
    seen = {}
    for wy in range(0, height, n):
        for wx in range(0, width, n):
            best = plain_best([m[wy : wy + n, wx : wx + n] for m in masks], merit, range(len(masks)))
            for c in cells:
                if c[0] == best and wy - grace < c[2] < wy + n + grace and wx - grace < c[3] < wx + n + grace:
                    key = ((wy, wx), c[0], c[5])
                    seen.setdefault(c, [key, key])[1] = key
    flat = sorted(seen, key=lambda c: seen[c][0])
    group = {}
    for c in flat:
        r = np.sqrt(c[4] / np.pi)
        near = [d for d in flat if abs(d[2] - c[2]) < r and abs(d[3] - c[3]) < r]
        if len({d[0] for d in near}) > 1:
            box = [max(0, int(min(d[k] for d in near) - 2)) if low else min((height, width)[k - 2], int(max(d[k] for d in near) + 2)) for k in (2, 3) for low in (True, False)]
            under = sum((masks[k][box[0] : box[1], box[2] : box[3]] > 0).astype(int) for k in {d[0] for d in near})
            if (under > 0).sum() > 3:
                for d in near:
                    group.setdefault(d, c)
    gone = set()
    for c in flat:
        if c in group:
            members = [d for d in flat if group.get(d) == group[c]]
            edges = []
            for k, size in ((2, height), (3, width)):
                stop = int(members[0][k] + n / 2)
                edges.append(slice(max(0, int(members[0][k] - n / 2)), size if stop > size - n / 2 else stop))
            best = plain_best([m[edges[0], edges[1]] for m in masks], merit, sorted({d[0] for d in members}))
            if c[0] != best:
                gone.add(c)
    tops = np.cumsum([0] + [m.max() for m in masks])
    out, method = np.zeros((height, width), int), np.full((height, width), -1)
    for c in sorted(flat, key=lambda c: seen[c][1]):
        cy, cx = max(1, int(c[2])), max(1, int(c[3]))
        shown = masks[c[0]][cy - 1 : cy + 1, cx - 1 : cx + 1].max()
        if shown and c not in gone:
            part = (slice(max(0, cy - 100), cy + 100), slice(max(0, cx - 100), cx + 100))
            hit = masks[c[0]][part] == shown
            out[part][hit], method[part][hit] = c[1] + tops[c[0]], c[0]
    return out, method


@pytest.mark.parametrize("merit", ["pop", "cstd", "j1"])
def test_fusion_against_pixels(spark, merit):
    rng = np.random.default_rng({"pop": 1, "cstd": 2, "j1": 3}[merit])
    y, x = np.mgrid[0:60, 0:150]
    centres = [(rng.integers(3, 57), rng.integers(3, 147)) for _ in range(55)]
    masks = []
    for k in range(3):
        m = np.zeros(y.shape, int)
        for label, (cy, cx) in enumerate(centres[: 55 - 5 * k], 1):
            r = rng.integers(2, 6)
            m[((y - cy - rng.integers(-2, 3)) ** 2 + (x - cx - rng.integers(-2, 3)) ** 2 <= r * r) & (m == 0)] = label
        masks.append(m)
    masks[1][:, 120:] = 0
    masks[0][10, 2:148] = 99  # longer than what is painted round its centre, and over many cells
    want, method = plain_fusion(masks, merit, 20)
    runs = runs_of(spark, *zip("abc", masks))
    found = fuse_masks(runs, spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "mask_id string, ord int"), merit, 20, y.shape).collect()
    got, by = np.zeros(y.shape, int), np.full(y.shape, -1)
    for r in found:
        assert not got[r.y, r.x0 : r.x1].any()
        got[r.y, r.x0 : r.x1], by[r.y, r.x0 : r.x1] = r.label, "abc".index(r.method)
    assert (got == want).all() and (by == method).all() and len(np.unique(want)) > 20


def test_fusion_works_out_its_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(5)
    runs = runs_of(spark, ("a", rng.integers(0, 4, (12, 12))), ("b", rng.integers(0, 4, (12, 12)))).persist()
    order = spark.createDataFrame([("a", 0), ("b", 1)], "mask_id string, ord int")
    assert fuse_masks(runs.mapInArrow(counted, runs.schema), order, "pop", 4).count() > 0 and seen.value == runs.count()


def test_near_cells_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], k, *map(float, rng.integers(0, 400, 2) / 2), int(4 ** rng.integers(0, 8))) for k in range(300)] + [("a", 300, 5.0, 5.0, 0)]
    cells = spark.createDataFrame(rows, "mask_id string, cell_id long, y_px double, x_px double, area_px long")
    want = {(p[1], q[1]) for p in rows for q in rows if max(abs(p[2] - q[2]), abs(p[3] - q[3])) < (p[4] / np.pi) ** 0.5}
    assert {tuple(r) for r in L.near_cells(cells, True, ["cell_id"], ["cell_id"]).collect()} == want
    found = L.near_cells(cells).select("a_mask", "a", "b_mask", "b").collect()
    assert len(found) == len(set(found)) and {(r.a, r.b) for r in found} == {(i, j) for i, j in want if (i + j) % 2 and 300 not in (i, j)} | {(i, j) for i, j in want if 300 in (i, j) and rows[i][0] != rows[j][0]}


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:60, 0:70]
    out = rng.random((60, 70)) * 5
    for cy, cx in ((12, 14), (20, 50), (45, 20), (44, 55)):
        out += 100 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 18)
    return out.astype(np.float32)


# ---- masks


def test_merge_masks_against_painting(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        planes = [np.where(rng.random((8, 8)) < 0.5, rng.integers(1, 5, (8, 8)), 0) for _ in range(3)]
        want, top, painted = np.zeros((8, 8), int), 0, []
        for p in planes:
            for label in np.unique(want[p > 0]):
                want[want == label] = 0
            want[p > 0] = p[p > 0] + top
            top += p.max()
            painted.append(p)
        order = spark.createDataFrame([(str(k), k) for k in range(3)], "mask_id string, ord int")
        got = L.merge_masks(runs_of(spark, *((str(k), p) for k, p in enumerate(planes))), order)
        assert (plane_from(got, (8, 8)) == want).all()


def test_runs_round_trip_geometry_and_filters(spark):
    rng = np.random.default_rng(2)
    p = np.where(rng.random((9, 11)) < 0.6, rng.integers(1, 6, (9, 11)), 0)
    r = runs_of(spark, ("m", p))
    assert (plane_from(L.to_runs(L.to_pixels(r)), p.shape) == p).all()
    for g in M.cell_geometry(r).collect():
        ys, xs = np.nonzero(p == g.cell_id)
        assert (g.area_px, g.ymin, g.xmin, g.ymax, g.xmax) == (len(ys), ys.min(), xs.min(), ys.max() + 1, xs.max() + 1)
        assert g.y_px == pytest.approx(ys.mean()) and g.x_px == pytest.approx(xs.mean())
    sizes = np.bincount(p.ravel())
    kept = np.where((sizes[p] >= 10) & (sizes[p] <= 12), p, 0)
    assert (plane_from(L.filter_size(r, 10, 12), p.shape) == kept).all()


def test_cut_and_replace(spark):
    old = np.zeros((6, 8), int)
    old[1:3, 1:3], old[3:6, 4:8] = 1, 2
    new = np.zeros((6, 8), int)
    new[2:5, 2:6] = 1
    a, b = runs_of(spark, ("m", old)), runs_of(spark, ("m", new))
    free = old.copy()
    free[(old == 0) & (new > 0)] = 3
    assert (plane_from(L.replace_in_region(a, b), old.shape) == free).all()
    boxed = np.where(old == 1, 0, old)
    boxed[new > 0] = 3
    assert (plane_from(L.replace_in_region(a, b, box=(0, 0, 5, 5)), old.shape) == boxed).all()


def test_windows_and_winner_j1(spark):
    a, b, c = (np.zeros((4, 4), int) for _ in range(3))
    a[0:2, 0:4], b[0:2, 0:4], c[3, 3] = 1, 2, 1
    r = runs_of(spark, ("a", a), ("b", b), ("c", c))
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "mask_id string, ord int")
    won = L.window_winner(L.window_stats(r, 4), L.window_jaccard(r, 4), order, "j1").collect()
    assert [x.mask_id for x in won] == ["a"]
    fused = plane_from(fuse_masks(r, order, "pop", 4), (4, 4))
    assert fused.any()


def test_rasterize_matches_even_odd(spark):
    ring = [(0.5, 0.5), (8.5, 1.5), (4.2, 4.1), (7.5, 8.5), (1.5, 7.5)]
    df = spark.createDataFrame([("a", 0, [{"x": x, "y": y} for x, y in ring])], "region string, ord int, ring array<struct<x:double,y:double>>")
    got = plane_from(L.rasterize(df, 10, 10), (10, 10)) > 0
    points = [(float(x), float(y)) for y in range(10) for x in range(10)]
    pts = spark.createDataFrame(points, "x double, y double").crossJoin(df)
    want = np.array([r[0] for r in pts.orderBy("y", "x").select(in_ring(F.col("ring"), F.col("x"), F.col("y"))).collect()]).reshape(10, 10)
    assert (got == want).all()


def test_prepared_regions(spark):
    ring = [(-5.0, 2.0), (0.5, 2.01), (3.0, 2.0), (3.0, 6.0), (-5.0, 6.0)]
    rows = [("a", [{"x": x, "y": y} for x, y in ring]), ("b", [{"x": 90.0, "y": 90.0}, {"x": 95.0, "y": 90.0}, {"x": 95.0, "y": 95.0}]), ("c", None)]
    df = spark.createDataFrame(rows, "region string, ring array<struct<x:double,y:double>>")
    got = R.prepare_regions(df, 0.5, 10, 10).collect()
    assert [r.region for r in got] == ["a"]
    points = [(p.x, p.y) for p in got[0].ring]
    assert points[0] == points[-1] and set(points) == {(0.0, 2.0), (3.0, 2.0), (3.0, 6.0), (0.0, 6.0)}
    assert (got[0].bbox.x0, got[0].bbox.x1) == (0.0, 3.0)


def test_expand_clean_and_contours(spark):
    p = np.zeros((20, 24), np.int32)
    p[5:8, 5:8], p[12:15, 16:20] = 3, 4
    for edge in (7, 24):
        grown = image_from(B.expand_labels(tiles_of(spark, p, edge), edge, 3), p.shape)
        y, x = np.mgrid[0:20, 0:24]
        for label in (3, 4):
            ys, xs = np.nonzero(p == label)
            near = ((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(-1) <= 9
            assert ((grown == label) == near).all()
    ringed = np.zeros((7, 9), int)
    ringed[1:6, 1:6] = 1
    ringed[3, 3] = 0
    ringed[2, 8] = 1
    full = plane_from(B.clean_objects(runs_of(spark, ("m", ringed)), True, True), ringed.shape)
    assert full.sum() == 25 and full[3, 3] == 1 and full[2, 8] == 0
    ring = B.contours(runs_of(spark, ("m", full))).first().ring
    assert len(ring) == 16 and {(q.x, q.y) for q in ring} >= {(1.5, 1.5), (5.5, 5.5)}


def test_connected_components_across_rows(spark):
    rng = np.random.default_rng(3)
    p = (rng.random((12, 14)) < 0.4).astype(int)
    got = plane_from(B.connected_components(runs_of(spark, ("m", p))), p.shape)
    want = B._parts(p > 0, corners=True)
    pairs = set(zip(got[p > 0].tolist(), want[p > 0].tolist()))
    assert len(pairs) == len(np.unique(want[p > 0])) == got.max()


def test_images_and_masks_stay_apart(spark, blobs):
    a, b = np.zeros((4, 6), int), np.zeros((4, 6), int)
    a[0, 0:3], b[1, 2:4], b[3, 0:2] = 1, 1, 2
    both = runs_of(spark, ("F", a), ("O", b))
    two = both.withColumn("image_id", F.lit("i")).unionByName(both.where("mask_id = 'F'").withColumn("image_id", F.lit("j")))
    parts = {(r.mask_id, r.y): r.label for r in B.connected_components(both).collect()}
    assert parts == {("F", 0): 1, ("O", 1): 1, ("O", 3): 2}
    assert {(r.image_id, r.mask_id, r.y): r.label for r in B.connected_components(two).collect()} == {("i", "F", 0): 1, ("i", "O", 1): 1, ("i", "O", 3): 2, ("j", "F", 0): 1}
    order = spark.createDataFrame([("F", 0), ("O", 1)], "mask_id string, ord int")
    over = runs_of(spark, ("O", a))
    clash = both.where("mask_id = 'F'").withColumn("image_id", F.lit("j")).unionByName(over.withColumn("image_id", F.lit("i")))
    assert {(r.image_id, r.label) for r in L.merge_masks(clash, order).collect()} == {("j", 1), ("i", 1)}
    assert L.overlaps(clash.where("image_id = 'i'"), clash.where("image_id = 'j'")).count() == 0
    assert {r.image_id for r in fuse_masks(two, order, "pop", 4).collect()} == {"i", "j"} and M.cell_geometry(two).count() == 4
    t = tiles_of(spark, blobs, 35)
    pair = t.unionByName(t.withColumn("image_id", F.lit("b")).withColumn("channel_idx", F.lit(3)))
    mean = B.score_mean(pair, 35, 4, lambda p: p + 1)
    assert {(r.image_id, r.channel_idx): r.n for r in mean.groupBy("image_id", "channel_idx").agg(F.count("*").alias("n")).collect()} == {("a", 0): blobs.size, ("b", 3): blobs.size}
    found = B.label_gauss_otsu(pair, 35, 1.0).groupBy("image_id", "mask_id").agg(F.max("label").alias("n")).collect()
    assert {(r.image_id, r.mask_id, r.n) for r in found} == {("a", "gauss_otsu", 4), ("b", "gauss_otsu_3", 4)}


def test_cell_means_of_tiles(spark, blobs):
    label = np.zeros(blobs.shape, np.int32)
    label[5:30, 3:40], label[33:50, 20:66] = 7, 9
    dark = blobs.copy()
    dark[6, 5] = np.nan
    t = tiles_of(spark, dark, 20).unionByName(tiles_of(spark, blobs * 2, 20, channel=1))
    got = {(r.cell_id, r.channel_idx): r for r in I.cell_means_of_tiles(t, tiles_of(spark, label, 20)).collect()}
    assert set(got) == {(c, k) for c in (7, 9) for k in (0, 1)}
    for (cell, channel), r in got.items():
        own = (np.nan_to_num(dark) if channel == 0 else blobs * 2)[label == cell].astype(float)
        assert r.n == own.size and r["mean"] == pytest.approx(own.mean(), rel=1e-6)


# ---- regions and statistics


def test_regions_rules_and_first_wins(spark):
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 3.9, 0.5)], "cell_id long, x_px double, y_px double")
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    regions = spark.createDataFrame([("A", 1, square), ("B", 0, square)], "region string, ord int, ring array<struct<x:double,y:double>>")
    got = {r.cell_id: (r.region, r.ambiguous) for r in R.assign_regions(cells, regions).collect()}
    assert got == {1: ("B", True), 2: ("outside", False), 3: ("B", True)}
    assert {r.cell_id for r in R.cells_in_regions(cells, regions, "raster").collect()} == {1, 3}


def test_ratios_at_the_edges(spark):
    rows = spark.createDataFrame([(1, "t", "a"), (2, "u", "a"), (3, "u", "b"), (4, "u", "b")], "cell_id long, cell_type string, region string")
    cells = rows.select("cell_id", "region")
    f = {r.cell_type: r.separation for r in R.fisher(rows, cells, "a", "b").collect()}
    assert f["t"] == pytest.approx(1.0) and f["u"] == pytest.approx(1.0)
    odds = {r.cell_type: r for r in R.odds_ratios(rows, cells, "a", "b").collect()}
    assert odds["t"].odds_ratio == float("inf") and odds["u"].odds_ratio == 0 and odds["u"].log2_odds_ratio == -float("inf")
    empty = R.fisher(rows, cells, "a", "none").first()
    assert np.isnan(empty.separation)


def test_gating_needs_every_marker(spark):
    states = spark.createDataFrame([(1, "A", 2), (1, "B", 1), (2, "A", 2), (3, "B", 2)], "cell_id long, marker string, state int")
    rules = spark.createDataFrame([(0, "x", "A", 1), (0, "x", "B", 2), (1, "y", "B", 1), (2, "none", "A", 0)], "type_ord int, cell_type string, marker string, required int")
    got = {(r.cell_id, r.cell_type) for r in G.gate(states, rules).collect()}
    assert got == {(1, "x"), (2, "Unknown"), (3, "y")}
    assert [r.required for r in G.cycle_rule(rules, "x", "A").where("cell_type = 'x' and marker = 'A'").collect()] == [2]
    assert {r.cell_type: r.type_ord for r in G.reorder_types(rules, ["y", "x"]).collect()} == {"y": 0, "x": 1, "none": 4}


def test_thresholds_on_constant_and_lone_values(spark):
    cm = spark.createDataFrame([(1, "flat", 3.0), (2, "flat", 3.0), (1, "lone", 4.0), (2, "lone", 0.0)], "cell_id long, marker string, mean double")
    for method in T.METHODS:
        got = {r.marker: r.threshold for r in T.thresholds(cm, method).collect()}
        assert got == {"flat": 3.0}, method
    manual = spark.createDataFrame([("flat", 9.0)], "marker string, threshold double")
    assert T.thresholds(cm, "otsu", manual).first().threshold == 9.0


def test_yeo_johnson_maximises_likelihood(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(1.5, 2.0, 300)
    cm = spark.createDataFrame([(k, "m", float(v)) for k, v in enumerate(x)], "cell_id long, marker string, mean double")
    lam = N.yeo_johnson_lambdas(cm).first().lam

    def score(p):
        y = np.log1p(x) if abs(p) < 1e-12 else ((x + 1) ** p - 1) / p
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * np.log1p(x).sum()

    assert score(lam) >= max(score(p) for p in np.linspace(-2, 3, 501)) - 1e-3


# ---- clusters and neighbours


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 6, 6))])
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").cache()


def _same_partition(df, column="cluster_id"):
    got = {r.cell_id: r[column] for r in df.collect()}
    return len(got) == 120 and len(set(got.values())) == 3 and all(len({got[k] for k in range(a, a + 40)}) == 1 for a in (0, 40, 80))


def test_clusterers_find_the_groups(points):
    x, df = points
    assert _same_partition(C.kmeans(df, 3, restarts=4))
    assert _same_partition(C.flowsom(df, 3, 3, 3))
    for linkage in ("ward", "complete", "average", "single"):
        assert _same_partition(C.hierarchical(df, 3, linkage)), linkage
    assert _same_partition(K.dbscan(df, eps=1.5, min_samples=5))
    assert _same_partition(K.communities(K.neighbor_graph(K.knn(df, 12)), 0.1))
    assert _same_partition(K.communities(K.jaccard_graph(K.knn(df, 15)), 0.1, refine=True))


@pytest.mark.parametrize("linkage, metric", [("ward", "euclidean"), ("complete", "manhattan"), ("average", "cosine"), ("single", "manhattan")])
def test_agglomeration_against_the_nearest_pair_each_time(spark, monkeypatch, linkage, metric):
    monkeypatch.setattr(linkage_module, "LAST", 20)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(70, 4)) + rng.integers(0, 3, (70, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"euclidean": np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), "manhattan": np.abs(x[:, None] - x[None]).sum(2), "cosine": 1 - u @ u.T}[metric]
    groups = [[k] for k in range(len(x))]

    def cost(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"complete": np.max, "average": np.mean, "single": np.min}[linkage](d[np.ix_(a, b)])

    while len(groups) > 6:
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups.pop(i)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(3)
    found = {}
    for r in C.hierarchical(vectors, 6, linkage, metric).collect():
        found.setdefault(r.cluster_id, set()).add(r.cell_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    assert [len(found[k]) for k in range(6)] == sorted(map(len, groups), reverse=True)


def test_knn_and_range_join_against_brute_force(points):
    x, df = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {(r.cell_id, r["rank"]): r.neighbor for r in K.knn(df, 3).collect()}
    for k in range(len(x)):
        order = [j for j in np.argsort(d[k], kind="stable") if j != k][:3]
        assert [near[k, r] for r in (1, 2, 3)] == order
    got = {(r.a, r.b) for r in K.within(df, 0.4).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.4))}


@pytest.mark.parametrize("own, block", [(False, 40), (True, 2048)])
def test_nearest_by_pivots_against_all_pairs(spark, monkeypatch, own, block):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "CELL", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(250, 5)), rng.normal(size=(150, 5)) * 0.1 + 8, np.zeros((60, 5)), np.ones((1, 5)) * 50])
    ids = rng.permutation(len(x)) * 3
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "cell_id long, vector array<double>").repartition(3)
    others = [(-1 - i, (rng.normal(size=5) * 4).tolist()) for i in range(20)]
    for asked, points in ((None, list(zip(ids.tolist(), x))), (spark.createDataFrame(others, "cell_id long, vector array<double>"), [(i, np.array(v)) for i, v in others])):
        want = set()
        for i, v in points:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [(float(d[r]), int(ids[r])) for r in np.lexsort((ids, d)) if own or ids[r] != i][:7]
            want |= {(int(i), r, n, round(e, 9)) for n, (e, r) in enumerate(order, 1)}
        assert {(r.cell_id, r.neighbor, r["rank"], round(r.distance, 9)) for r in K.knn(vectors, 7, include_self=own, queries=asked).collect()} == want
    assert K.knn(vectors.where("false"), 3).count() == 0
    assert K.knn(vectors.limit(3), 7).groupBy("cell_id").count().select("count").distinct().collect()[0][0] == 2


def test_knn_looks_at_the_first_few_copies_of_a_vector_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.where((np.arange(700) % 7 == 0)[:, None], rng.random((700, 3)), [[0.5, 0.5, 0.5]])  # 600 copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vector array<double>").repartition(3)
    held, real = [], K.pivots_of
    monkeypatch.setattr(K, "pivots_of", lambda vectors, scratch: held.append(vectors.count()) or real(vectors, scratch))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for own in (True, False):
        want = set()
        for i in range(len(x)):
            near = [int(j) for j in np.lexsort([np.arange(len(x)), d[i]]) if own or j != i][:4]
            want |= {(i, j, r + 1, round(float(d[i, j]), 9)) for r, j in enumerate(near)}
        assert {(r.cell_id, r.neighbor, r["rank"], round(r.distance, 9)) for r in K.knn(df, 4, include_self=own).collect()} == want
    assert held == [104, 105]  # 100 vectors of their own, and 4 or 5 copies


@pytest.mark.parametrize("spread", [1.0, 1e-7, 1e9])
def test_knn_without_structure_reads_the_table_in_strips(spark, monkeypatch, spread):
    """Where no cell can be ruled out, queries aren't dealt to all cells; copies are asked once; the rows are those of all pairs."""
    real, passes = K._met, []
    monkeypatch.setattr(K, "_met", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(K, "CELL", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 40))
    x[300:400] = x[:100]
    x[400:420] = x[7]
    x[450:] = 3 + spread * x[450:]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(3)
    d = np.array([np.sqrt(((x - v) ** 2).sum(1)) for v in x])
    for own in (False, True):
        want = {(i, int(j), r + 1) for i in range(500) for r, j in enumerate([j for j in np.lexsort([np.arange(500), d[i]]) if own or j != i][:6])}
        assert {(r.cell_id, r.neighbor, r["rank"]) for r in K.knn(df, 6, include_self=own).collect()} == want
    assert len(passes) == 2 or spread != 1.0  # the pass for bounds, for each of both
    monkeypatch.setattr(K, "ASKED", 30)
    monkeypatch.setattr(K, "COLUMNS", 17)
    best = K._Best(x, np.full(500, np.inf), 4)
    for lo in range(0, 500, 90):
        best.see(np.arange(lo, min(lo + 90, 500)), x[lo : lo + 90])
    assert (best.ids == [np.lexsort([np.arange(500), row])[:4] for row in d]).all()


def test_pivots_rule_cells_out(spark, monkeypatch):
    """Rows that are seen grow far less than with the square of the table, where there is structure."""
    monkeypatch.setattr(K, "CELL", 16)
    seen = []
    for n in (400, 4000):
        rng = np.random.default_rng(1)
        x = rng.random((n, 3))
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vector array<double>").repartition(4)
        _, p = K.pivots_of(vectors, Scratch(spark, "pivots"))
        d = p.distances(x)
        near = np.array([np.partition(np.sqrt(((x - v) ** 2).sum(1)), 5)[5] for v in x])
        seen.append(((p.first(d, 6) | p.others(d, near)) * p.sizes).sum())
    assert seen[1] < 40 * seen[0] and seen[1] < 0.25 * 4000**2


def test_rounds_tell_the_modularity_that_ends_a_level(spark, monkeypatch):
    """Without a further pass over the graph."""
    def further(*_):
        raise AssertionError("a pass of its own")

    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 40, (160, 2)) if a <= b]  # loops too
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in set(links)], "a long, b long, w double")
    both = edges.union(edges.where("a <> b").select("b", "a", "w"))
    total, loops = edges.count(), edges.where("a = b").count()
    state = both.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))
    state = state.select("node", (F.col("node") % 5).alias("c"), "k", F.lit(0).alias("r"))
    moved = K._moved(both.where("a <> b").join(state.select(F.col("node").alias("a"), "k"), "a"), state, total, 0.5)
    told = moved.agg(F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("mass")).alias("square")).first()
    assert abs((told.inner + 2 * loops) / (2 * total) - 0.5 * told.square / (2 * total) ** 2 - K.modularity(both, state.select("node", "c"), total, 0.5)) < 1e-12
    monkeypatch.setattr(K, "CALM", 0)
    monkeypatch.setattr(K, "modularity", further)
    assert K.communities(edges, 0.5).select("cell_id").distinct().count() == state.count()


@pytest.mark.parametrize("refine", [False, True])
def test_rounds_of_moves_leave_the_links_where_they_are(spark, monkeypatch, refine):
    """A graph of few enough nodes takes no round of joins; many ranges of nodes, one of them without links, give what one gives."""
    from histoframe.operators import moves

    rng = np.random.default_rng(11)
    links = {tuple(sorted(e)): 1.0 for e in rng.integers(0, 120, (500, 2)).tolist() if e[0] != e[1] and (e[0] // 20 == e[1] // 20 or rng.random() < 0.1)}
    links |= {(200 + k, 200 + k): 1.0 for k in range(30)}
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a long, b long, w double").repartition(3)
    scores = []

    def plain(found):
        both = graph.union(graph.where("a <> b").select("b", "a", "w"))
        return K.modularity(both, spark.createDataFrame(list(found.items()), "node long, c long"), sum(links.values()), 0.7)

    found = []
    with monkeypatch.context() as m:
        m.setattr(K, "_settled", None)
        m.setattr(K, "_refined", None)
        for nodes in (8, 8_192):
            m.setattr(moves, "NODES", nodes)
            found.append({r.cell_id: r.cluster_id for r in K.communities(graph, 0.7, refine).collect()})
            scores.append(plain(found[-1]))
    assert found[0] == found[1] and len(found[0]) == len({n for e in links for n in e})
    assert scores[0] > 0.95 * plain({n: min(n // 20, 6) if n < 200 else n for n in found[0]})  # the groups that links are planted in
    for c in set(found[0].values()) if refine else ():
        inside = {n for n in found[0] if found[0][n] == c}
        reached, todo = set(), [min(inside)]
        while todo:
            n = todo.pop()
            reached.add(n)
            todo += [m for e in links if n in e for m in e if m in inside and m not in reached]
        assert reached == inside


def test_refined_communities_are_connected_and_no_worse(spark):
    """A ring of cliques, a bad bridge, and random links: Leiden's parts are connected, its modularity isn't below Louvain's."""
    rng = np.random.default_rng(6)
    edges = {(6 * g + i, 6 * g + j): 1.0 for g in range(10) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.8}
    edges |= {(6 * g, (6 * g + 7) % 60): 1.0 for g in range(10)}
    for _ in range(40):
        i, j = sorted(rng.integers(0, 60, 2).tolist())
        if i < j:
            edges[i, j] = edges.get((i, j), 0) + 0.5
    graph = spark.createDataFrame([(min(a, b), max(a, b), w) for (a, b), w in edges.items()], "a long, b long, w double")
    total = sum(edges.values())

    def plain(found):
        k = {}
        for (a, b), w in edges.items():
            k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inner = sum(w for (a, b), w in edges.items() if found[a] == found[b])
        return inner / total - sum((sum(v for n, v in k.items() if found[n] == c) / (2 * total)) ** 2 for c in set(found.values()))

    scores = {}
    for refine in (False, True):
        found = {r.cell_id: r.cluster_id for r in K.communities(graph, 1.0, refine).collect()}
        assert set(found) == set(range(60)) and set(found.values()) == set(range(len(set(found.values()))))
        scores[refine] = plain(found)
        both = graph.union(graph.select("b", "a", "w"))
        state = spark.createDataFrame(list(found.items()), "node long, c long")
        assert abs(K.modularity(both, state, total) - scores[refine]) < 1e-9
        if refine:
            for c in set(found.values()):
                reached, stack = set(), [next(n for n in found if found[n] == c)]
                while stack:
                    n = stack.pop()
                    reached.add(n)
                    stack += [m for e in edges if n in e for m in e if m != n and found[m] == c and m not in reached]
                assert reached == {n for n in found if found[n] == c}
    assert scores[True] >= scores[False] - 1e-9 > 0.5


def test_quality_and_components(points, spark):
    x, df = points
    clusters = df.select("cell_id", (F.col("cell_id") / 40).cast("int").alias("cluster_id"))
    of = np.arange(120) // 40
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for k in range(120):
        a = d[k, of == of[k]].sum() / 39
        b = min(d[k, of == c].mean() for c in range(3) if c != of[k])
        s.append((b - a) / max(a, b))
    assert C.silhouette(df, clusters).first().silhouette == pytest.approx(np.mean(s))
    lone = clusters.withColumn("cluster_id", F.when(F.col("cell_id") == 0, 9).otherwise(F.col("cluster_id")))
    of[0], s = 9, []
    for k in range(120):
        a = d[k, of == of[k]].sum() / max((of == of[k]).sum() - 1, 1)
        b = min(d[k, of == c].mean() for c in set(of.tolist()) - {int(of[k])})
        s.append((b - a) / max(a, b) if k else 0.0)
    assert C.silhouette(df, lone).first().silhouette == pytest.approx(np.mean(s))
    assert C.silhouette(df, clusters.withColumn("cluster_id", F.lit(0))).first().silhouette == 0
    assert tuple(C.silhouette(df, clusters.where("false")).first()) == (None, 0)
    assert C.parallel_analysis(df) in (1, 2)
    flat = np.array([[r.x, r.y] for r in C.project_2d(df).orderBy("cell_id").collect()])
    u, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(flat), np.abs(u[:, :2] * sv[:2]), atol=1e-6)


# ---- tiles


@pytest.mark.parametrize("edge", [16, 70])
def test_filters_do_not_depend_on_tiles(spark, blobs, edge):
    t = tiles_of(spark, blobs, edge)
    assert np.allclose(image_from(I.median(t, edge, 3), blobs.shape), I.median_of(blobs, I.disk(1)), atol=1e-4)
    assert np.allclose(image_from(I.gaussian(t, edge, 1.5), blobs.shape), I.gaussian_of(blobs, 1.5), atol=1e-3)
    want = np.maximum(blobs - I.rolling_ball_of(I.gaussian_of(blobs, 1), 4), 0)
    assert np.allclose(image_from(I.subtract_background(t, edge, 1, 4), blobs.shape), want, atol=1e-3)
    opened = I._fold(I._fold(blobs, I.disk(1), np.minimum), I.disk(1), np.maximum)
    assert np.allclose(image_from(I.opening(t, edge, 3), blobs.shape), opened, atol=1e-4)


def test_hot_pixels_and_scaling(spark):
    p = np.full((20, 20), 7, np.float32)
    p[4, 4] = p[15, 3] = 900
    assert (image_from(I.remove_hotpixels(tiles_of(spark, p, 8), 8), p.shape) == 7).all()
    ramp = np.arange(400, dtype=np.float32).reshape(20, 20)
    got = image_from(I.rescale(tiles_of(spark, ramp, 9), 2, 98), ramp.shape)
    a, b = np.percentile(ramp, (2, 98))
    assert np.allclose(got, np.clip((ramp - a) / (b - a), 0, 1), atol=1e-5)
    assert np.allclose(image_from(I.retile(tiles_of(spark, ramp, 9), 6), ramp.shape), ramp)
    assert image_from(I.clahe(tiles_of(spark, ramp, 20), 20), ramp.shape).max() <= 1.0 + 1e-6
    both = tiles_of(spark, ramp, 10).union(tiles_of(spark, ramp + 4, 10, channel=1))
    assert np.allclose(image_from(I.merge_channels(both, 0, 1, 2), ramp.shape), ramp + 2)


def plain_parts(mask):
    """Connected parts, corners included, by flooding from each pixel in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not out[start]:
            n += 1
            out[start], stack = n, [start]
            while stack:
                y, x = stack.pop()
                for a in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                    for b in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                        if mask[a, b] and not out[a, b]:
                            out[a, b] = n
                            stack.append((a, b))
    return out


@pytest.mark.parametrize("share", [0.25, 0.5])
def test_parts_do_not_depend_on_tiles(spark, share):
    rng = np.random.default_rng(int(share * 100))
    mask = rng.random((50, 61)) < share
    want = plain_parts(mask)
    for edge in (5, 64):
        assert (plane_from(B.components_of_tiles(tiles_of(spark, mask.astype(np.int32) * 7, edge), "m"), mask.shape) == want).all()
    labelled = np.where(mask, rng.integers(1, 4, mask.shape), 0)  # runs of a row touch, with other labels
    for tile in (8,):
        local = parts.parts_in_runs(runs_of(spark, ("m", labelled)), tile)
        assert (plane_from(parts.joined_parts(local, Scratch(spark, "t")), mask.shape) == want).all()
    twice = runs_of(spark, ("m", labelled)).union(runs_of(spark, ("m", labelled)).withColumn("x1", F.col("x0") + 1))
    assert (plane_from(B.connected_components(twice), mask.shape) == want).all()
    one = spark.createDataFrame([("F", 0, 0, 3, 1), ("F", 0, 3, 5, 2)], RUN)
    assert [(r.x0, r.x1, r.label) for r in B.connected_components(one).collect()] == [(0, 5, 1)]
    assert B.connected_components(one.where("false")).count() == 0


def test_exact_ranks(spark):
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=(23, 31)), rng.normal(size=(23, 31)).astype(np.float32), rng.integers(0, 5, (23, 31)).astype(np.uint16), -np.abs(rng.normal(size=(23, 31)).astype(np.float16))):
        both = tiles_of(spark, values, 8).union(tiles_of(spark, values * 2, 8, channel=3))
        got = {r.channel_idx: r.p for r in ranks.tile_percentiles(both, [0.02, 0.5, 0.998, 1.0]).collect()}
        for channel, own in ((0, values), (3, values * 2)):
            assert np.allclose(got[channel], np.percentile(own.astype(float), (2, 50, 99.8, 100)), rtol=1e-12, atol=0)
    rows = [(m, float(v)) for m in "ab" for v in (rng.normal(size=500) if m == "a" else rng.integers(0, 3, 400))] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "marker string, value double").repartition(5)
    got = {r.marker: r.p for r in ranks.percentiles(df, [0.05, 0.5, 0.95], "marker", "value").collect()}
    for m in "abc":
        assert np.allclose(got[m], np.percentile([v for k, v in rows if k == m], (5, 50, 95)))
    assert set(got) == {"a", "b", "c"} and ranks.percentiles(df.where("false"), [0.5], "marker", "value").count() == 0


def test_li_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(m, float(v)) for m, values in (("a", np.concatenate([rng.gamma(2, 3, 300), rng.normal(40, 5, 90)])), ("b", rng.integers(1, 30, 200)), ("c", [3.0, 3.0]), ("d", [1.0])) for v in values]
    df = spark.createDataFrame(rows, "marker string, mean double").repartition(4)
    want = {}
    for m in "abc":
        v = np.array([x for k, x in rows if k == m and x > 0])
        low, gaps = v.min(), np.diff(np.unique(v))
        w, tolerance = v - low, (gaps.min() if len(gaps) else 0) / 2
        t, before = w.mean(), None
        while before is None or abs(t - before) > tolerance:
            fore, back = w[w > t], w[w <= t]
            if not len(fore) or not back.any() or fore.mean() == back.mean():
                break
            before, t = t, (back.mean() - fore.mean()) / (np.log(back.mean()) - np.log(fore.mean()))
        want[m] = low + t
    for block in (7, 4096):
        monkeypatch.setattr(T, "LI_BLOCK", block)
        got = {r.marker: r.threshold for r in T.li(df).collect()}
        assert set(got) == set(want) and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_cell_means_where_extents_differ(spark):
    rng = np.random.default_rng(10)
    image, label = rng.random((13, 17)).astype(np.float32), rng.integers(0, 4, (11, 20)).astype(np.int32)
    image[2, 3] = np.nan
    t = tiles_of(spark, image, 6).union(tiles_of(spark, image * 3, 6, channel=1))
    got = {(r.cell_id, r.channel_idx): (r.n, r.sum) for r in I.cell_means_of_tiles(t, tiles_of(spark, label, 6)).collect()}
    a, b = np.nan_to_num(image[:11, :17].astype(float)), label[:11, :17]
    assert set(got) == {(k, c) for k in (1, 2, 3) for c in (0, 1)}
    for (k, c), (n, total) in got.items():
        assert n == (b == k).sum() and abs(total - a[b == k].sum() * (3 if c else 1)) < 1e-4


def test_segmentation_finds_the_blobs(spark, blobs):
    for edge in (20, 70):
        got = plane_from(B.label_gauss_otsu(tiles_of(spark, blobs, edge), edge, 1.0), blobs.shape)
        assert got.max() == 4
        labels = image_from(B.label_voronoi_otsu(tiles_of(spark, blobs, edge), edge, 2, 2, 31), blobs.shape)
        names = [labels[c] for c in ((12, 14), (20, 50), (45, 20), (44, 55))]
        assert len(set(names)) == 4 and min(names) > 0 and (labels == plain_voronoi(blobs, 2, 2, 31)).all()


def plain_flood(mask, seeds):
    """Step by step from all seeds at once; a pixel takes the smallest label among its reached neighbours."""
    out = np.where(mask, seeds, 0)
    while True:
        after = out.copy()
        for y, x in zip(*np.nonzero(mask & (out == 0))):
            near = [out[a, b] for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and out[a, b]]
            if near:
                after[y, x] = min(near)
        if (after == out).all():
            return out
        out = after


def plain_maxima(image):
    """Pixels of plateaus, corners included, that no greater pixel touches."""
    out, seen = np.zeros(image.shape, bool), np.zeros(image.shape, bool)
    for start in np.ndindex(image.shape):
        if seen[start]:
            continue
        plateau, stack, top = [start], [start], True
        seen[start] = True
        while stack:
            y, x = stack.pop()
            for a in range(max(0, y - 1), min(image.shape[0], y + 2)):
                for b in range(max(0, x - 1), min(image.shape[1], x + 2)):
                    top &= image[a, b] <= image[y, x]
                    if image[a, b] == image[y, x] and not seen[a, b]:
                        seen[a, b] = True
                        plateau.append((a, b))
                        stack.append((a, b))
        for p in plateau:
            out[p] = top
    return out


def plain_voronoi(image, spot, outline, size):
    blurred = I.gaussian_of(image, outline).astype(np.float32).astype(float)
    scaled = ((blurred - blurred.min()) / (blurred.max() - blurred.min()) * 255).astype(np.float32).astype(float)
    mask = scaled > I.gaussian_of(scaled, (size - 1) / 6) + 1
    return plain_flood(mask, plain_parts(plain_maxima(I.gaussian_of(image, spot)) & mask))


def test_floods_go_round_corners(spark):
    """A long winding mask over many tiles, plateaus over tile borders, ties, and parts without a seed."""
    mask = np.zeros((24, 40), np.int32)
    mask[1::4, :] = 1
    for k, y in enumerate(range(1, 21, 4)):
        mask[y : y + 5, 39 if k % 2 == 0 else 0] = 1
    mask[10:13, 15:18] = 1
    seeds = np.zeros(mask.shape, int)
    seeds[1, 0:3], seeds[21, 20], seeds[1, 30], seeds[9, 20] = 4, 2, 3, 4
    rows = spark.createDataFrame([("a", 0, int(y), int(x), int(x) + 1, int(seeds[y, x])) for y, x in zip(*np.nonzero(seeds))], "image_id string, channel_idx int, y long, x0 long, x1 long, label long")
    want = plain_flood(mask > 0, seeds)
    for edge in (5, 64):
        states = flooding.flood(flooding.seeded(tiles_of(spark, mask, edge), rows, edge), Scratch(spark, "flood"))
        assert (image_from(flooding.label_tiles_of(states), mask.shape) == want).all()
    rng = np.random.default_rng(5)
    steps = np.kron(rng.integers(0, 4, (8, 9)), np.ones((3, 3)))
    bits = flooding.peaks_of(steps)
    keep = np.zeros(steps.shape, bool)
    names = plain_parts(bits & 1 > 0)
    for k in range(1, names.max() + 1):
        keep |= (names == k) & (not (bits[names == k] & 2).any())
    assert (keep == plain_maxima(steps)).all()


@pytest.mark.parametrize("edge", [9, 64])
def test_cells_grow_with_a_line(spark, edge):
    p = np.zeros((30, 40), np.int32)
    p[2:9, 3:10], p[2:9, 10:16], p[20, 20], p[25:27, 30:36], p[14:16, 5:30], p[9:14, 28] = 5, 3, 9, 4, 7, 7
    p[20:29, 2:4], p[28, 4:9], p[20, 4:9] = 6, 6, 6  # its centroid isn't its own
    core = np.zeros(p.shape, int)
    for y, x in zip(*np.nonzero(p)):
        around = [(a, b) for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < 30 and 0 <= b < 40]
        core[y, x] = p[y, x] if all(p[a, b] == p[y, x] for a, b in around) else 0
    for k in set(np.unique(p)) - set(np.unique(core)):
        own = np.argwhere(p == k)
        centre = own.mean(0).astype(int)
        core[tuple(min(own.tolist(), key=lambda c: (((np.array(c) - centre) ** 2).sum(), c)))] = k
    whole = plain_flood(p > 0, core)
    whole = np.where((whole == 0) & (p > 0), p, whole)
    lit = np.argwhere(whole > 0)
    square = np.array([[((lit - (y, x)) ** 2).sum(1).min() for x in range(40)] for y in range(30)])
    grown = whole.copy()
    for y, x in sorted(map(tuple, np.argwhere((square > 0) & (square <= 16))), key=lambda c: square[c]):
        near = [(square[a, b], grown[a, b]) for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < 30 and 0 <= b < 40 and square[a, b] < square[y, x]]
        grown[y, x] = min(near)[1]
    want = grown.copy()
    for y, x in np.argwhere(grown > 0):
        want[y, x] = 0 if any(0 < grown[a, b] < grown[y, x] for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < 30 and 0 <= b < 40) else want[y, x]
    assert (image_from(B.expand_separated(tiles_of(spark, p, edge), edge, 4), p.shape) == want).all()


def test_models_supplied_by_the_user(spark, blobs):
    t = tiles_of(spark, blobs, 20)
    assert np.allclose(image_from(B.infer_tiles(t, 20, 4, lambda p: p * 2), blobs.shape), blobs * 2)
    mean = B.score_mean(t, 20, 4, lambda p: p + 1).collect()
    assert len(mean) == blobs.size and all(abs(r.value - 1 - blobs[r.y, r.x]) < 1e-4 for r in mean)
    p = np.zeros(blobs.shape, np.int32)
    p[10:15, 12:17], p[30:34, 30:34] = 1, 2
    cells = spark.createDataFrame([(1, 12.0, 14.0), (2, 31.5, 31.5)], "cell_id long, y_px double, x_px double")
    found = B.classify_cells(t, tiles_of(spark, p, 20), cells, 20, lambda b: (b[:, 0] * b[:, 1]).sum((1, 2)) / b[:, 1].sum((1, 2)) > 20, crop=16)
    assert {r.cell_id: r.state for r in found.collect()} == {1: 2, 2: 1}


# ---- sources and streams


def test_zarr_round_trip_and_edges(spark, tmp_path):
    spark.dataSource.register(zarr_tiles.ZarrTiles)
    whole = np.arange(2 * 5 * 7, dtype=np.int16).reshape(2, 5, 7)
    rows = None
    for c in range(2):
        t = tiles_of(spark, whole[c], 4, channel=c)
        rows = t if rows is None else rows.union(t)
    store = str(tmp_path / "s.zarr")
    zarr_tiles.write_zarr_tiles(rows, store, "images/s001/0", (2, 5, 7), 4, "int16")
    df = spark.read.format("zarr_tiles").option("array", "images/s001/0").load(store)
    for c in range(2):
        assert (image_from(df.where(F.col("channel_idx") == c), (5, 7)) == whole[c]).all()
    (tmp_path / "s.zarr/images/s001/0/c/1/1/1").unlink()
    assert image_from(df.where("channel_idx = 1 and ty = 1 and tx = 1"), (5, 7)).sum() == 0
    meta = {"labels/m": {"attributes": {"key": "Cells"}}, "labels/m/0": {"shape": [5, 7]}, "extra_aux/x": {"shape": [35], "attributes": {"original_shape": [5, 7]}}}
    (tmp_path / "s.zarr/zarr.json").write_text(json.dumps({"attributes": {"schema_version": 1}, "consolidated_metadata": {"metadata": meta}}))
    found = {r.key: (r.section, r.original_shape) for r in project.read_project(spark, store).collect()}
    assert found == {"Cells": ("labels", [5, 7]), "x": ("extra_aux", [5, 7])}
    (tmp_path / "s.zarr/zarr.json").write_text(json.dumps({"attributes": {"schema_version": 9}, "consolidated_metadata": {"metadata": meta}}))
    with pytest.raises(ValueError):
        project.read_project(spark, store)
    cut = zarr_tiles.read_window(df, 0, 1, 5, 2, 6)
    assert (image_from(cut, (5, 7))[1:5, 2:6] == whole[0][1:5, 2:6]).all()
    maxima = M.channel_maxima(I.pixel_values(df.where("channel_idx = 0")), "channel_idx")
    assert maxima.first().data_max == whole[0].max()


def test_catalog_channels_and_panel(spark, tmp_path):
    meta = {
        "images": {"node_type": "group"},
        "images/s10": {"attributes": {"ome": {"omero": {"channels": [{"label": 0}]}}}},
        "images/s2": {"attributes": {"ome": {"omero": {"channels": [{"label": "Ir191"}, {"label": "b"}]}}}},
        "images/Stitched": {"attributes": {}},
        "images/s10/0": {"shape": [3, 4, 5]},
        "images/s2/0": {"shape": [2, 4, 5]},
        "images/Stitched/0": {"shape": [4, 5]},
    }
    (tmp_path / "zarr.json").write_text(json.dumps({"consolidated_metadata": {"metadata": meta}}))
    assert [r.name for r in catalog.read_catalog(spark, str(tmp_path)).orderBy("ord").collect()] == ["Stitched", "s2", "s10"]
    names = {(r.image_id, r.channel_idx): r.name for r in catalog.read_channels(spark, str(tmp_path)).collect()}
    assert [names["s10", k] for k in range(3)] == ["0", "Channel 0", "Channel 1"] and ("s2", 2) not in names
    (tmp_path / "p.xml").write_text("<P><AcquisitionChannel><ChannelName>Ir191</ChannelName><ChannelLabel>191Ir_DNA1</ChannelLabel></AcquisitionChannel><AcquisitionChannel><ChannelName>b</ChannelName><ChannelLabel></ChannelLabel></AcquisitionChannel></P>")
    rich = catalog.enrich_panel(catalog.read_channels(spark, str(tmp_path)), catalog.read_panel(spark, str(tmp_path / "p.xml")))
    assert {r.name for r in rich.where("image_id = 's2'").collect()} == {"Ir191 / DNA1", "b"}
    lv = catalog.levels(spark.createDataFrame([("a", 0, 800), ("a", 1, 400), ("a", 2, 200)], "image_id string, level int, width int"))
    assert catalog.select_level(lv, 0.5).first().level == 1 and catalog.select_level(lv, 1.0).first().level == 0
    layers = spark.createDataFrame([(0, "Cell: x"), (1, " "), (2, "Type: ")], "ord int, name string")
    assert [(r.kind, r.name) for r in catalog.classify_layers(layers).orderBy("ord").collect()] == [("cell_mask", "x"), ("mask", "Imported Mask 2"), ("type_mask", "Type 3")]


def test_geojson_both_ways(spark, tmp_path):
    a = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 2], [0, 0]]]}, "properties": {"name": " Lung "}}
    b = {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [5, 6], [5, 5]]]]}, "properties": {"name": "Lesion"}}
    c = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}, "properties": {}}
    for doc in ({"type": "FeatureCollection", "features": [a, b, c]}, [a, b, c]):
        (tmp_path / "r.geojson").write_text(json.dumps(doc))
        got = geojson.read_geojson_regions(spark, str(tmp_path / "r.geojson")).orderBy("feature", "part").collect()
        assert [r.name for r in got] == ["Lung", "Lesion 1", "Lesion 2"]
        assert [(p.x, p.y) for p in got[0].ring] == [(0, 0), (2, 0), (0, 2)]
    (tmp_path / "r.geojson").write_text(json.dumps({**a, "properties": {}}))
    one = geojson.read_geojson_regions(spark, str(tmp_path / "r.geojson"))
    assert one.first().name == "Region 1"
    back = json.loads(geojson.features_json(one.select(F.lit(1).alias("id"), "name", "part", "ring"), "detection").first().value)
    assert back["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]]}
    assert back["properties"] == {"objectType": "detection", "name": "Region 1"}


def test_shapes_rules_and_bundle(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    assert shapes.rings_of(shapes.wkb_of([ring])) == [ring] and shapes.rings_of(shapes.wkb_of([ring, ring])) == [ring, ring]
    assert shapes.rings_of(struct.pack("<BIdd", 1, 1, 0.0, 0.0)) == []
    df = spark.createDataFrame([("Lung", 1, [{"x": x, "y": y} for x, y in ring])], "name string, part int, ring array<struct<x:double,y:double>>")
    shapes.write_shapes(df, str(tmp_path / "g"))
    assert [(r.name, len(r.ring)) for r in shapes.read_shapes(spark, str(tmp_path / "g")).collect()] == [("Lung", 3)]
    (tmp_path / "rules.csv").write_text("Marker,T,B\nCD3,+,-\nCD20,,+\nZZ,+,\n")
    channels = spark.createDataFrame([("CD3",), ("CD20",)], "name string")
    rules, ignored = tables.read_rules(spark, str(tmp_path / "rules.csv"), channels)
    assert {(r.cell_type, r.marker): r.required for r in rules.collect()} == {("T", "CD3"): 1, ("B", "CD3"): 2, ("T", "CD20"): 0, ("B", "CD20"): 1}
    assert [r.marker for r in ignored.collect()] == ["ZZ"]
    assert {r.Marker: (r["T"], r.B) for r in tables.rules_matrix(rules).collect()} == {"CD3": ("+", "-"), "CD20": ("", "+")}
    (tmp_path / "bad.csv").write_text("X,T\n")
    with pytest.raises(ValueError):
        tables.read_rules(spark, str(tmp_path / "bad.csv"))
    cells = spark.createDataFrame([(1, 2.0, 3.0, 4)], "cell_id long, x_px double, y_px double, area_px long")
    cm = spark.createDataFrame([(1, "CD3", 5.0)], "cell_id long, marker string, mean double")
    tables.write_cell_bundle(M.to_microns(cells, 0.5), cm, str(tmp_path / "b"), cm.select("cell_id", "marker", F.lit(2).alias("state")))
    assert spark.read.parquet(str(tmp_path / "b/obsm/spatial")).first().spatial == [1.0, 1.5]
    assert spark.read.parquet(str(tmp_path / "b/layers/positive")).first().value is True


def test_names_and_coverage(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a/b"), (2, "__"), (3, "a_b_1")], "ord int, name string")
    assert [r.safe_name for r in safe_names(df, "name", "ord").orderBy("ord").collect()] == ["a_b", "a_b_1", "element", "a_b_1_1"]
    row = spark.range(1).select(*(coverage(F.lit(v), F.lit(0.0), F.lit(10.0), F.lit(a), F.lit(b)).alias(n) for n, v, a, b in (("x", 5.0, 0.0, 1.0), ("y", 5.0, 0.25, 0.75), ("z", 5.0, 0.5, 0.5), ("u", 1.0, 0.5, 0.5)))).first()
    assert (row.x, row.y, row.z, row.u) == (0.5, 0.5, 1.0, 0.0)


def drained(spark, tmp_path, files=None, every=16):
    stream = spark.readStream.schema(incremental.SCHEMA).option("maxFilesPerTrigger", files or 1000).parquet(str(tmp_path / "in"))
    incremental.incremental_cell_stats(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True, compact_every=every).awaitTermination()
    return {(r.image_id, r.cell_id): (r.n, r.sum, r.max) for r in incremental.cell_statistics(spark, str(tmp_path / "out")).collect()}


def send(spark, tmp_path, rows):
    """One file of readings: image, ty, tx, version, part, cell, value."""
    spark.createDataFrame([(*r[:6], "m", r[6]) for r in rows], incremental.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_incremental_statistics(spark, tmp_path):
    send(spark, tmp_path, [("i", 0, 0, 1, 0, 1, 2.0), ("i", 0, 0, 1, 0, 1, 4.0), ("i", 0, 1, 1, 0, 1, 10.0), ("i", 0, 0, 1, 0, 0, 99.0)])
    assert drained(spark, tmp_path) == {("i", 1): (3, 16.0, 10.0)}
    send(spark, tmp_path, [("i", 0, 0, 2, 0, 1, 1.0), ("i", 0, 0, 2, 0, 2, 5.0)])
    want = {("i", 1): (2, 11.0, 10.0), ("i", 2): (1, 5.0, 5.0)}
    assert drained(spark, tmp_path) == want and drained(spark, tmp_path) == want
    send(spark, tmp_path, [("i", 0, 0, 2, 0, 1, 1.0), ("i", 0, 0, 2, 0, 2, 5.0)])  # a part again
    send(spark, tmp_path, [("i", 0, 0, 1, 0, 7, 70.0)])  # an old version, late
    assert drained(spark, tmp_path) == want
    send(spark, tmp_path, [("i", 0, 1, 2, None, 0, 3.0)])  # a tile without cells
    assert drained(spark, tmp_path) == {("i", 1): (1, 1.0, 1.0), ("i", 2): (1, 5.0, 5.0)}


@pytest.mark.parametrize("files, every", [(1, 2), (2, 3), (7, 1)])
def test_stream_is_the_same_in_any_batches(spark, tmp_path, files, every):
    """A tile in several files, two images with the same tiles, tiles sent again by part and by version, one emptied."""
    for rows in (
        [("i", 0, 0, 1, None, 7, 2.0)],
        [("i", 0, 0, 1, None, 7, 4.0), ("j", 0, 0, 1, None, 7, 100.0)],
        [("j", 0, 1, 1, 0, 1, 1.0), ("j", 0, 1, 1, 0, 2, 1.0)],
        [("j", 0, 1, 1, 1, 1, 2.0)],
        [("j", 0, 1, 1, 1, 1, 2.0)],
        [("i", 1, 1, 1, None, 9, 5.0)],
        [("i", 1, 1, 2, None, 0, 5.0)],
        [("i", 2, 0, 1, None, 3, 8.0), (None, 0, 0, 1, None, 4, 1.0)],
        [("i", 2, 0, 2, None, 3, 1.0)],
        [("i", 2, 0, 2, None, 3, 2.0)],
    ):
        send(spark, tmp_path, rows)
    assert drained(spark, tmp_path, files, every) == {("i", 7): (2, 6.0, 4.0), ("j", 7): (1, 100.0, 100.0), ("j", 1): (2, 3.0, 2.0), ("j", 2): (1, 1.0, 1.0), ("i", 3): (2, 3.0, 2.0), (None, 4): (1, 1.0, 1.0)}
    if every == 2:
        assert len(list((tmp_path / "out").glob("state-*"))) == 2 and len(list((tmp_path / "out").glob("batch-*"))) < 10


def test_overlays_are_blended_in_the_order_of_their_kinds(spark):
    """Two layers over one channel, one of them smaller, against numpy; a tile without a channel; cells without a colour."""
    rng = np.random.default_rng(4)
    plane = rng.random((6, 8)).astype("float32")
    mask, typed = rng.integers(0, 4, (6, 8)).astype("int32"), rng.integers(0, 5, (4, 8)).astype("int32")
    fields = "image_id string, level int, ty int, tx int, h int, w int, dtype string, pixels binary"

    def row(p, tx=0):
        return ("i", 0, 0, tx, *p.shape, p.dtype.name, p.tobytes())

    tiles = spark.createDataFrame([(0, *row(plane))], "channel_idx int, " + fields)
    channels = spark.createDataFrame([(0, 1.0, 0.5, 0.25, 0.0, 1.0, 0.0, 0.5, 1.0)], "channel_idx int, r double, g double, b double, data_min double, data_max double, range_min double, range_max double, alpha double")
    labels = spark.createDataFrame([("a", *row(typed)), ("b", *row(mask)), ("b", *row(mask, 1))], "layer string, " + fields)
    layers = spark.createDataFrame([("a", "type", 0.5), ("b", "mask", 0.75)], "layer string, kind string, opacity double")
    colours = spark.createDataFrame([("i", "a", k, 0.0, 0.25 * k, 1.0) for k in (1, 2, 4)], "image_id string, layer string, cell_id long, r double, g double, b double")
    found = {r.tx: np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in I.composite_rgb(tiles, channels, 1.5, I.overlay_tiles(labels, layers, colours)).collect()}
    under = {0: np.clip(plane.astype(float) / 0.5, 0, 1)[:, :, None] * np.array([1.0, 0.5, 0.25]) * 1.5, 1: np.zeros((6, 8, 3))}
    for tx, out in under.items():
        for y, x in np.ndindex(6, 8):
            if mask[y, x]:
                own = [mask[y, x] * c % 1 for c in (0.6180339887, 0.7548776662, 0.569840291)]
                out[y, x] = 0.25 * out[y, x] + 0.75 * np.array(own)
            if tx == 0 and y < 4 and typed[y, x] in (1, 2, 4):
                out[y, x] = 0.5 * out[y, x] + 0.5 * np.array([0, 0.25 * typed[y, x], 1])
        assert np.abs((np.clip(out, 0, 1) * 255).astype(int) - found[tx]).max() <= 1


def test_sweeps_over_runs_as_over_pixels(spark):
    """Overlapping, equal and crossing runs in rows that one chunk of a sweep doesn't hold."""
    rng = np.random.default_rng(5)
    n = 12_000
    y, x0, mask = rng.integers(0, 3, n), rng.integers(0, 9_000, n), rng.integers(0, 2, n)
    width = np.where(rng.random(n) < 0.01, 3_000, rng.integers(0, 6, n))
    x0[:400] = 50
    rows = [(int(m), "FO"[m], int(r), int(a), int(a + w), int(v)) for m, r, a, w, v in zip(mask, y, x0, width, rng.integers(0, 40, n))]
    df = spark.createDataFrame(rows + rows[:200] * 2, "image_id int, mask_id string, y long, x0 int, x1 int, label int").drop("image_id")
    want = L.to_runs(L.to_pixels(df).groupBy("mask_id", "y", "x").agg(F.max("label").alias("label")))
    got = L.flattened(df)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    blocked = np.zeros((3, 13_000), bool)
    walls = [r for r in rows if r[1] == "O" and r[4] - r[3] < 10]
    for _, _, r, a, b, _ in walls:
        blocked[r, a:b] = True
    own = [r for r in rows + rows[:200] if r[1] == "F"]
    left = []
    for _, m, r, a, b, v in own:
        free = np.flatnonzero(np.diff(np.concatenate([[0], ~blocked[r, a:b], [0]]).astype(int)))
        left += [(m, r, int(a + s), int(a + e), v) for s, e in free.reshape(-1, 2)]
    kind = "mask_id string, y long, x0 int, x1 int, label int"
    cut = L.cut_by(spark.createDataFrame([r[1:] for r in own], kind), spark.createDataFrame([r[1:] for r in walls], kind))
    assert sorted(tuple(c) for c in cut.collect() if c.x1 > c.x0) == sorted(left)


def test_resize_of_tall_images(spark):
    rows = spark.createDataFrame([(99_999, 3, 1.5), (0, 0, 2.5)], "y int, x int, value double")
    got = sorted((r.y, r.x, r.value) for r in I.resize_nearest(rows, 100_000, 4, 50_000, 2).collect())
    assert got == [(0, 0, 2.5)]
    rows = spark.createDataFrame([(99_998, 2, 1.5)], "y int, x int, value double")
    assert [(r.y, r.x) for r in I.resize_nearest(rows, 100_000, 4, 50_000, 2).collect()] == [(49_999, 1)]


def test_silhouette_takes_every_row(spark):
    """More rows than were once sampled: two places, and one row far from its cluster."""
    df = spark.range(10_500).select(F.col("id").alias("cell_id"), F.array(F.when(F.col("id") == 10_499, 1.0).otherwise((F.col("id") % 2).cast("double"))).alias("vector"))
    clusters = df.select("cell_id", F.when(F.col("cell_id") == 10_499, 0).otherwise(F.col("cell_id") % 2).cast("int").alias("cluster_id"))
    found = C.silhouette(df, clusters).first()
    assert found.n == 10_500
    a0 = 1 / 5_250  # 5,250 rows at 0 and one at 1 are cluster 0
    assert found.silhouette == pytest.approx((5_250 * (1 - a0) + 5_249 - 1) / 10_500, abs=1e-9)


def test_silhouette_copies_no_row_for_every_block(spark, monkeypatch):
    """Rows aren't dealt to pairs of blocks; strips against the whole table give the sums of all pairs: copies, lone rows, tight far clusters."""
    monkeypatch.setattr(C, "pairs_of_blocks", None, raising=False)
    for name, n in (("COMPARED", 300), ("TOGETHER", 5), ("WIDE", 6)):
        monkeypatch.setattr(C, name, n)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(4, 4)), 5, 0), 1e6 + rng.normal(size=(40, 4)) * 1e-3])
    of = np.concatenate([np.arange(60) % 30, np.arange(20) % 3, [40] * 20 + [41] * 19 + [42]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.array([[d[k, of == c].sum() / max(1, (of == c).sum() - (c == of[k])) for c in np.unique(of)] for k in range(len(x))])
    mine = np.unique(of)[None] == of[:, None]
    a, b = means[mine], np.where(mine, np.inf, means).min(1)
    s = np.where((of[:, None] == of[None]).sum(1) > 1, (b - a) / np.maximum(a, b), 0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(3)
    found = C.silhouette(df, spark.createDataFrame(list(enumerate(of.tolist())), "cell_id long, cluster_id int")).first()
    assert found.n == len(x) and found.silhouette == pytest.approx(s.mean(), abs=1e-9)
    order = np.argsort(of, kind="stable")
    blocks = [(of[order[k : k + 7]], np.ones(len(order[k : k + 7]), np.int64), x[order[k : k + 7]]) for k in range(0, len(x), 7)]
    assert np.allclose(C._silhouettes(of, x, iter(blocks)), s, atol=1e-9)


def test_visits_come_in_bounded_batches(spark, monkeypatch):
    """Every query visits every cell; no batch holds more than COPIES rows, so a batch of queries isn't copied as a whole."""
    monkeypatch.setattr(K.Pivots, "first", lambda self, d, need: np.ones(d.shape, bool))
    monkeypatch.setattr(K, "COPIES", 100)
    df = spark.createDataFrame([(k, [float(k)]) for k in range(50)], "cell_id long, vector array<double>").coalesce(1)
    pivots = K.Pivots(np.arange(20.0)[:, None])
    sizes = []

    class Frame:
        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"cell_id": pa.array(range(50)), "vector": pa.array([[float(k)] for k in range(50)]), "bound": pa.array([None] * 50, pa.float64())})
            sizes.extend(b.num_rows for b in run(iter([batch])))

    K._visits(Frame(), type("Shared", (), {"value": pivots}), 3)
    assert sizes == [100] * 10 and df.count() == 50


def test_a_query_is_sent_once_to_a_group_of_cells(spark, monkeypatch):
    """Where no cell can be ruled out, copies of a query grow with the groups of cells, not with the cells."""
    monkeypatch.setattr(K, "CELL", 16)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(2000, 40)))], "cell_id long, vector array<double>").repartition(3)
    dealt, pivots = K.pivots_of(df, Scratch(spark, "groups"))
    assert len(pivots.points) > 40 and len(set(pivots.groups.tolist())) <= 34 and np.bincount(pivots.groups, pivots.sizes).sum() == 2000
    shared = spark.sparkContext.broadcast(pivots)
    visits = K._visits(df.withColumn("bound", F.lit(1e9)), shared, 0)
    assert visits.count() == 2000 * len(set(pivots.groups.tolist())) == K._visit_counts(df.withColumn("bound", F.lit(1e9)), shared, 0).agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("eps", [0.0, 0.7])
def test_density_clusters_without_a_row_a_pair(spark, monkeypatch, eps):
    """Counts, core parts and border cells against all pairs, in many cells, blocks and slices."""
    for name, n in (("CELL", 8), ("BLOCK", 20), ("SLICE", 30), ("ASKED", 7)):
        monkeypatch.setattr(K, name, n)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(60, 3)) * 0.2 + 6, np.zeros((30, 3)), [[90.0, 0, 0]]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps if eps else np.eye(len(x), dtype=bool)
    assert {r.cell_id: r.n for r in K.reach_counts(df, eps).collect()} == dict(enumerate(near.sum(1).tolist()))
    core, of = near.sum(1) >= 5, np.arange(len(x))
    for _ in range(len(x)):
        of = np.array([of[core & near[k]].min() if core[k] else of[k] for k in range(len(x))])
    names = {c: n for n, c in enumerate(sorted(set(of[core].tolist())))}
    want = {}
    for k in range(len(x)):
        reach = [names[of[j]] for j in np.flatnonzero(near[k] & core)]
        want[k] = (names[of[k]], True) if core[k] else (min(reach, default=-1), False)
    assert {r.cell_id: (r.cluster_id, r.core) for r in K.dbscan(df, eps, 5).collect()} == want


def test_average_cosine_linkage_keeps_no_row_a_pair(spark, monkeypatch):
    """Many copies, blocks of a few rows: the merges of the table of all pairs, from sizes and sums alone."""
    for name, n in (("LAST", 8), ("LAST_MEANS", 8), ("BLOCK", 12)):
        monkeypatch.setattr(linkage_module, name, n)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(30, 5)), np.repeat(rng.normal(size=(3, 5)), 6, 0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(2)
    want = {tuple(r[:2]): r.h for d in linkage_module._by_pairs(linkage_module.unit_vectors(df), "average", "cosine", Scratch(spark, "pairs")) for r in d.collect()}
    monkeypatch.setattr(linkage_module, "_by_pairs", None)
    got = {tuple(r[:2]): r.h for d in linkage_module._by_sums(linkage_module.unit_vectors(df), "average", Scratch(spark, "sums")) for r in d.collect()}
    assert sorted(round(h, 9) + 0.0 for h in got.values()) == sorted(round(h, 9) + 0.0 for h in want.values()) and len(got) == len(x) - 1
    assert C.hierarchical(df, 4, "average", "cosine").select("cluster_id").distinct().count() == 4


def test_average_cosine_linkage_searches_only_what_changed(spark, monkeypatch):
    """Copies are one cluster at once; later rounds ask for clusters that are new or whose nearest has merged; zeros are alike to none."""
    monkeypatch.setattr(linkage_module, "LAST_MEANS", 6)
    real, asked = linkage_module._average_nearest, []
    monkeypatch.setattr(linkage_module, "_average_nearest", lambda clusters, some: asked.append((clusters.count(), some.count())) or real(clusters, some))
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(40, 4)), np.repeat(rng.normal(size=(2, 4)), 10, 0), np.zeros((2, 4))])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell_id long, vector array<double>").repartition(2)
    merges = [tuple(r) for d in linkage_module._by_sums(linkage_module.unit_vectors(df), "average", Scratch(spark, "sums")) for r in d.collect()]
    heights = sorted(h for *_, h in linkage_module._merged(list(range(62)), np.ones(62), 1 - u @ u.T, "average"))
    assert np.allclose(sorted(h for *_, h in merges), heights, atol=1e-9) and len(merges) == 61
    assert asked[0] == (44, 44) and sum(some for _, some in asked) < 0.8 * sum(n for n, _ in asked)
    assert np.allclose(sorted(h for *_, h in linkage_module._merged_means(list(range(62)), np.ones(62), u.copy())), heights, atol=1e-9)


def test_tile_tasks_hold_one_tile_at_a_time(monkeypatch):
    """Tasks over tiles give their results tile by tile, and take no batch of tiles as a whole into Python."""
    import pyarrow as pa

    plane = np.arange(16, dtype="<f4").reshape(4, 4)
    row = {"image_id": "i", "level": 0, "channel_idx": 0, "ty": 0, "tx": 0, "y0": 0, "x0": 0, "h": 4, "w": 4, "dtype": "float32", "pixels": plane.tobytes()}
    batch = pa.RecordBatch.from_pylist([row | {"ty": k, "y0": 4 * k} for k in range(50)])

    class Frame:
        schema = None

        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    for found in (I.map_tiles(Frame(), lambda p, _: p + 1), I.pixel_values(Frame())):
        assert len(found) == 50 and sum(b.num_rows for b in found) in (50, 800)
    states = pa.RecordBatch.from_pylist([{k: row.get(k) for k in flooding._NAMES} | {"ty": k, "kind": 0, "mask": np.ones(16, np.uint8).tobytes(), "keys": np.full(16, flooding.FAR, np.int64).tobytes()} for k in range(50)], flooding._SCHEMA)
    assert [b.num_rows for b in flooding._flooded(iter([states]))] == [1] * 50
