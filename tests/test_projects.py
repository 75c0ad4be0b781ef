"""Stores without an index, session settings, exports, crops with neighbouring channels, and the exact spanning tree."""

import json
from datetime import datetime

import numpy as np
import pytest

from histoframe.operators import clusters as C
from histoframe.operators import labels as B
from histoframe.sources import catalog, tables, zarr_tiles

from .test_operators import tiles_of


def test_store_without_consolidated_metadata_is_listed(spark, tmp_path):
    store = str(tmp_path / "plain.zarr")
    plane = np.arange(20, dtype=np.int16).reshape(4, 5)
    for name, labels in (("s10", ["CD3"]), ("s+2 x", None), ("stitched", None)):
        zarr_tiles.write_zarr_tiles(tiles_of(spark, plane, 4), store, f"images/{name}/0", (1, 4, 5), 4, "int16", labels)
    assert [r.name for r in catalog.read_catalog(spark, store).orderBy("ord").collect()] == ["stitched", "s+2 x", "s10"]
    assert {(r.image_id, r.channel_idx, r.name) for r in catalog.read_channels(spark, store).collect()} == {("stitched", 0, "0"), ("s+2 x", 0, "0"), ("s10", 0, "CD3")}
    (tmp_path / "plain.zarr/zarr.json").write_text('{"attributes": {}}')
    assert catalog.read_catalog(spark, store).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, str(tmp_path / "none"))


def test_session_keeps_its_settings(spark, tmp_path):
    layers = spark.createDataFrame([(1, 'two "b"', "mask"), (0, "one", "channel")], "ord int, name string, kind string")
    names = spark.createDataFrame([(10, "T cells"), (2, "B\ncells")], "cluster_id int, name string")
    rules = spark.createDataFrame([(0, "T", "CD3", 1), (0, "T", "CD20", 2)], "type_ord int, cell_type string, marker string, required int")
    path = str(tmp_path / "session")
    catalog.write_session(layers, path, 0.325, names, rules)
    assert [(r.name, r.kind) for r in catalog.read_session(spark, path).orderBy("ord").collect()] == [("one", "channel"), ('two "b"', "mask")]
    found = catalog.read_session_settings(spark, path).collect()
    assert len(found) == 1 and found[0].pixel_size == 0.325 and found[0].cluster_names == {10: "T cells", 2: "B\ncells"}
    assert {tuple(r) for r in found[0].rules} == {(0, "T", "CD3", 1), (0, "T", "CD20", 2)}
    catalog.write_session(layers.where("false"), path)
    empty = catalog.read_session_settings(spark, path).first()
    assert (empty.pixel_size, empty.cluster_names, empty.rules) == (None, None, None) and not catalog.read_session(spark, path).count()


def test_bundle_has_export_time_and_region(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2.0, 3.0)], "cell_id long, x_px double, y_px double")
    means = spark.createDataFrame([(1, "CD3", 5.0)], "cell_id long, marker string, mean double")
    tables.write_cell_bundle(cells, means, str(tmp_path / "b"), region="Cells")
    row = spark.read.parquet(str(tmp_path / "b/uns/export")).first()
    datetime.fromisoformat(row.export_date)
    assert (row.region, row.region_key, row.instance_key) == ("Cells", "region", "cell_id")
    assert spark.read.parquet(str(tmp_path / "b/obs")).first().region == "Cells"
    tables.write_cell_bundle(cells, means, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/uns/export")).first().region is None
    assert "region" not in spark.read.parquet(str(tmp_path / "c/obs")).columns


def test_crops_hold_neighbouring_channels(spark):
    label = np.zeros((20, 20), np.int64)
    label[8:12, 8:12] = 1
    planes = [np.full((20, 20), v, np.float64) for v in (1, 10, 100)]
    rows = tiles_of(spark, planes[0], 20, channel=0)
    for k in (1, 2):
        rows = rows.union(tiles_of(spark, planes[k], 20, channel=k))
    cells = spark.createDataFrame([(1, 9.5, 9.5)], "cell_id long, y_px double, x_px double")
    weights = np.array([1, 2, 3])

    def model(crops):
        assert crops.shape[1:] == (5, 8, 8)
        return (crops[:, :3].mean((2, 3)) * weights).sum(1)

    found = {r.channel_idx: r.p for r in B.classify_cells(rows, tiles_of(spark, label, 20), cells, 20, model, crop=8, n_side=1).collect()}
    assert found == {0: 2 + 30, 1: 1 + 20 + 300, 2: 10 + 200}


def _cut_tree(x, n):
    """Clusters by Prim's tree over all pairs, its n - 1 longest edges cut."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, edges = {0}, []
    while len(inside) < len(x):
        a, b = min(((i, j) for i in inside for j in range(len(x)) if j not in inside), key=lambda e: d[e])
        edges.append((d[a, b], a, b))
        inside.add(b)
    of = np.arange(len(x))
    for _, a, b in sorted(edges)[: len(x) - n]:
        of[of == of[a]] = of[b]
    return {frozenset(np.flatnonzero(of == c).tolist()) for c in set(of)}


@pytest.mark.parametrize("k", [1, 60])
def test_single_linkage_is_exact_beyond_the_nearest(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, s, (12, 2)) for c, s in (((0, 0), 0.1), ((2, 0), 0.3), ((0, 5), 0.2), ((9, 9), 1.0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vector array<double>").cache()
    groups = {}
    for r in C.single_linkage(df, 5, k).collect():
        groups.setdefault(r.cluster_id, set()).add(r.cell_id)
    assert {frozenset(g) for g in groups.values()} == _cut_tree(x, 5)


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_tiles_are_read_with_and_without_pushed_filters(spark, tmp_path, pushdown):
    store = str(tmp_path / "push.zarr")
    planes = [np.arange(30, dtype=np.int16).reshape(5, 6) + 100 * c for c in range(3)]
    tiles = tiles_of(spark, planes[0], 2, channel=0)
    for c in (1, 2):
        tiles = tiles.union(tiles_of(spark, planes[c], 2, channel=c))
    zarr_tiles.write_zarr_tiles(tiles, store, "images/s1/0", (3, 5, 6), 2, "int16")
    before = spark.conf.get(zarr_tiles.PUSHDOWN)
    spark.conf.set(zarr_tiles.PUSHDOWN, pushdown)
    try:
        df = zarr_tiles.read_tiles(spark, store, "images/s1/0")
        places = lambda rows: {(r.channel_idx, r.ty, r.tx) for r in rows.collect()}
        assert len(places(df)) == df.count() == 27
        assert places(df.where("channel_idx in (1, 2) and channel_idx = 1 and ty = 2")) == {(1, 2, x) for x in range(3)}
        assert places(df.where("channel_idx in (0, 2) and x0 > 1 and y0 < 2")) == {(c, 0, x) for c in (0, 2) for x in (1, 2)}
        assert places(df.where("channel_idx = 1 and tx = 9")) == set()
        r = df.where("channel_idx = 2 and ty = 2 and tx = 1").first()
        assert (np.frombuffer(r.pixels, "<i2").reshape(r.h, r.w) == planes[2][4:5, 2:4]).all()
    finally:
        spark.conf.set(zarr_tiles.PUSHDOWN, before)
    reader = zarr_tiles.PruningReader(store, "images/s1/0")
    assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 16), (16, 27)]


def test_levels_share_their_elements_metadata(spark, tmp_path):
    """Levels written in any order are all listed, with their scales; channel labels stay."""
    store, element = str(tmp_path / "s"), tmp_path / "s/images/a"
    whole = np.arange(80, dtype=np.int16).reshape(8, 10)
    zarr_tiles.write_zarr_tiles(tiles_of(spark, whole[::2, ::2], 4), store, "images/a/1", (1, 4, 5), 4, "int16", ["DAPI"])
    zarr_tiles.write_zarr_tiles(tiles_of(spark, whole, 4), store, "images/a/0", (1, 8, 10), 4, "int16")
    ome = json.loads((element / "zarr.json").read_text())["attributes"]["ome"]
    assert [(d["path"], d["coordinateTransformations"][0]["scale"]) for d in ome["multiscales"][0]["datasets"]] == [("0", [1.0, 1.0, 1.0]), ("1", [1.0, 2.0, 2.0])]
    assert [c["label"] for c in ome["omero"]["channels"]] == ["DAPI"]
