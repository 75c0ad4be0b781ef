"""MinHash near-duplicates with tensored banding.

Two small collections of short minhash keys are computed for a text, `tables` keys of `rows` minhashes in each. A table of
the index is a pair of one key from either collection, so `tables`^2 tables of 2 * rows minhashes need no more than
2 * tables * rows minhash computations. A pair of texts with similarity s meets in some table unless it misses all keys of
a collection: with chance 2 (1 - s^rows)^tables at most, which `tables` is chosen for.

Texts with equal shingle sets are one class, found by a grouping; only classes are searched. Keys that one class alone has
go before the tables are formed. Each bucket first links its classes to one representative, the best for each class;
confirmed links give components. Then classes of different components in one bucket are compared with each other, in
blocks inside tasks, on sketches that a linked pair passes but for a chance below one in 10^8; components that are alike
so are a family. Within a family, blocks of classes are compared with each other on their full sets, a matrix product a
pair of blocks, but for blocks of one component. Tasks return which components belong together, never pairs: so no pairs
of a group are written out, and no link between two different components is lost to a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.operators.components import connected_components
from histoframe.llm.encoder import slices
from histoframe.llm.hashing import mix, word_hashes
from histoframe.llm.keys import free_name, with_row_keys
from histoframe.scratch import Scratch

ROWS = 3
MISS = 1e-4
BLOCK = 256
FAMILY_BLOCK = 512
SALTS = 32  # tasks that may share the rows of one family
SLICE = 1_000_000
_ODD = np.random.default_rng(9).integers(0, 1 << 63, (2, 512), np.uint64) * np.uint64(2) + np.uint64(1)


def table_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Keys in each collection, so that a pair at the limit is missed with a chance of `miss` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct n-word shingles of each text; of all its words, where there are fewer."""
    hashes, starts = word_hashes(texts)
    out = []
    if len(hashes) >= n:
        rolled = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            rolled = mix(rolled + hashes[k : k + len(rolled)])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix(whole + hashes[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], tables: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For sets that aren't empty: the 2 * tables keys (int64), and a byte of each minhash."""
    joined = np.concatenate(sets)
    cuts = np.cumsum([0, *map(len, sets)])[:-1]
    low = np.empty((len(sets), 2 * tables * rows), np.uint64)
    for k in range(low.shape[1]):
        low[:, k] = np.minimum.reduceat((joined ^ _ODD[0, k]) * _ODD[1, k], cuts)
    keys = np.zeros((len(sets), 2 * tables), np.uint64)
    parts = mix(low).reshape(len(sets), 2 * tables, rows)
    for r in range(rows):
        keys = mix(keys + parts[:, :, r])
    return keys.view(np.int64), (mix(low) & np.uint64(255)).astype(np.uint8)


def _signed(docs: DataFrame, n: int, tables: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sketch binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(batch.column(1).to_pylist(), SLICE):
                sets = shingle_sets(some, n)
                full = [k for k, x in enumerate(sets) if len(x)]
                keys, sketches = [None] * len(some), [None] * len(some)
                digests = np.zeros((2, len(some)), np.uint64)
                if full:
                    found, bytes_ = signatures([sets[k] for k in full], tables)
                    for place, k in enumerate(full):
                        keys[k], sketches[k] = found[place], bytes_[place].tobytes()
                        digests[0, k] = sets[k].sum(dtype=np.uint64)
                        digests[1, k] = mix(sets[k]).sum(dtype=np.uint64)
                columns = [batch.column(0).slice(at, len(some)), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(d.view(np.int64)) for d in digests), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(batch.column(1).to_pylist(), SLICE):
                sets = [x.view(np.int64) for x in shingle_sets(some, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = both.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _alike(percent: int, tables: int) -> int:
    """Equal sketch bytes that a linked pair has, but for six standard deviations."""
    h, s = 2 * tables * ROWS, percent / 100
    return math.floor(h * s - 6 * math.sqrt(h * s * (1 - s)))


def _star_scores(percent: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            same = (x == y).sum(1)
            keep = pa.array(same >= _alike(percent, tables))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same.astype(np.int32)).filter(keep)], ["a", "b", "same"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of rows that are sorted by the keys; only the last group at hand is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        values = [rows[c].to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        at = 0
        for cut in cuts.tolist():
            yield rows.slice(at, cut - at).combine_chunks()
            at = cut
        held = rows.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components that a matrix of linked rows and columns brings together, each with the smallest one it reaches."""
    names, of = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = of[: len(left)], of[len(left) :]
    label = np.arange(len(names))
    none = len(names)
    while True:
        now = label.copy()
        np.minimum.at(now, y, np.where(linked, now[x][:, None], none).min(0, initial=none))
        np.minimum.at(now, x, np.where(linked, now[y][None], none).min(1, initial=none))
        if (now == label).all():
            break
        label = now
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _alike_groups(percent: int, tables: int):
    """Components that may be linked: in a bucket's block pair, those joined by pairs that pass size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("bucket", "lo", "hi")):
            comps, sizes, sides = (rows[c].to_numpy() for c in ("component", "n", "side"))
            sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            x, y = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)  # 2: both sides of a block with itself
            same = np.zeros((len(x), len(y)), np.int16)
            for k in range(sketches.shape[1]):
                same += sketches[x, k][:, None] == sketches[y, k][None]
            small, large = np.minimum(sizes[x][:, None], sizes[y][None]), np.maximum(sizes[x][:, None], sizes[y][None])
            a, b = _joined((same >= _alike(percent, tables)) & (100 * small >= percent * large), comps[x], comps[y])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _linked_groups(percent: int):
    """Components that are linked: in a family's block pair, all rows against all columns on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("family", "lo", "hi")):
            comps, sides = rows["component"].to_numpy(), rows["side"].to_numpy()
            lists = rows["shingles"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            shingle = lists.flatten().to_numpy()
            of = np.repeat(np.arange(rows.num_rows), sizes)
            _, column, counts = np.unique(shingle, return_inverse=True, return_counts=True)
            twice = counts[column] > 1  # what one text alone has is in no intersection
            place = np.cumsum(counts > 1) - 1
            column, of = place[column[twice]], of[twice]
            x, y = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            shared = np.zeros((len(x), len(y)), np.float32)
            order = np.argsort(column, kind="stable")
            column, of = column[order], of[order]
            width = 4096
            for lo in range(0, int(counts[counts > 1].size), width):
                a, b = np.searchsorted(column, (lo, lo + width))
                dense = np.zeros((rows.num_rows, width), np.float32)
                dense[of[a:b], column[a:b] - lo] = 1
                shared += dense[x] @ dense[y].T
            both = sizes[x][:, None] + sizes[y][None] - shared
            a, b = _joined(100 * shared >= percent * both, comps[x], comps[y])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(family, lo, hi, side, id, component): rows dealt to pairs of blocks of about FAMILY_BLOCK rows of a family.

    A component of a block or more has blocks of its own, and no block pair within it is made.
    """
    sizes = rows.groupBy("family", "component").agg(F.count("*").alias("c"))
    large = F.col("c") >= FAMILY_BLOCK
    rest = sizes.where(~large).groupBy("family").agg(F.sum("c").alias("pool")).where(F.col("pool") > FAMILY_BLOCK).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.join(sizes, ["family", "component"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    placed = salted.join(rest, ["family", "salt"], "left")
    parts = F.ceil(F.when(large, F.col("c")).otherwise(F.coalesce("pool", F.lit(1))) / FAMILY_BLOCK)
    owner = F.when(large, F.col("component"))
    placed = placed.withColumn("block", F.xxhash64(F.coalesce(owner, F.lit(-1)), F.pmod(F.xxhash64("id"), parts))).withColumn("owner", owner)
    blocks = placed.select("family", "block", "owner").distinct()
    a, b = blocks.toDF("family", "lo", "owner_lo"), blocks.toDF("family", "hi", "owner_hi")
    pairs = a.join(b, "family").where("lo <= hi and not coalesce(owner_lo = owner_hi, false)").select("family", "lo", "hi")
    own = placed.select("family", "block", "id", "component")
    left = own.join(pairs, (own.family == pairs.family) & (own.block == pairs.lo)).select(pairs.family, "lo", "hi", F.when(F.col("lo") == F.col("hi"), 2).otherwise(0).alias("side"), "id", "component")
    right = own.join(pairs.where("lo < hi"), (own.family == pairs.family) & (own.block == pairs.hi)).select(pairs.family, "lo", "hi", F.lit(1).alias("side"), "id", "component")
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept, as links of `percent` or more join components.

    component_id is the smallest doc_id reachable; kept holds for it alone. Texts without words, and nulls, have no
    shingles, link with nothing and are kept. Rows that share a doc_id count as one document with several texts. A row
    without a doc_id takes no part: its component_id is null and it is kept. Extra columns are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    tables = table_count(percent)
    parts_wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))  # block pairs are heavy, whatever their bytes
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.table(_signed(docs, words, tables), "signed")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    classes = own.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes, "classes")

    halves = classes.select("id", F.posexplode("keys").alias("place", "half"))
    met = halves.groupBy("place", "half").agg(F.count("*").alias("c")).where("c > 1").select("place", "half")
    shared = halves.join(met, ["place", "half"], "left_semi").groupBy("id").agg(F.collect_list(F.struct("place", "half")).alias("halves"))
    first = F.filter("halves", lambda x: x["place"] < tables)
    second = F.filter("halves", lambda x: x["place"] >= tables)
    tensored = shared.select("id", F.explode(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["place"], x["half"], y["place"], y["half"]))))).alias("bucket"))
    reps = tensored.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("rep"), F.count("*").alias("members")).where("members > 1")
    met_in = scratch.table(tensored.join(reps, "bucket"), "buckets")

    light = classes.select("id", "n", "sketch")
    stars = met_in.where("id <> rep").groupBy(F.col("id").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("times"))
    stars = stars.join(light.toDF("a", "n_a", "s_a"), "a").join(light.toDF("b", "n_b", "s_b"), "b")
    stars = stars.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")
    scored = stars.mapInArrow(_star_scores(percent, tables), "a long, b long, same int")
    best = scored.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    best = scratch.table(best, "stars")

    active = met_in.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.table(_sets(docs.join(active, "doc_id", "left_semi"), words), "sets")
    links = scratch.table(_confirmed(best, sets, percent), "links")
    parts = scratch.table(connected_components(links, scratch, "round-1"), "parts")

    component = F.coalesce("component", "id").alias("component")
    placed = met_in.select("bucket", "id").join(parts.toDF("id", "component"), "id", "left").select("bucket", "id", component)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y").select("bucket", "m")
    rows = placed.join(mixed, "bucket").join(light, "id")
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when((F.col("own") < F.col("other")), 0).otherwise(1)
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "component", "n", "sketch")
    dealt = rows.repartition(parts_wanted, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    maybe = scratch.table(dealt.mapInArrow(_alike_groups(percent, tables), "a long, b long").distinct(), "maybe")
    families = scratch.table(connected_components(maybe, scratch, "families").toDF("component", "family"), "families")

    nodes = active.select(F.col("doc_id").alias("id")).join(parts.toDF("id", "component"), "id", "left").select("id", component)
    dealt = _block_pairs(nodes.join(families, "component")).join(sets, "id").select("family", "lo", "hi", "side", "component", "shingles")
    dealt = dealt.repartition(parts_wanted, "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    more = scratch.table(dealt.mapInArrow(_linked_groups(percent), "a long, b long").distinct(), "more")
    joined = connected_components(more, scratch, "round-2").toDF("component", "whole")
    parts = scratch.table(nodes.join(joined, "component", "left").select(F.col("id").alias("node"), F.coalesce("whole", "component").alias("component")), "components")

    scratch.drop("buckets", "stars", "sets", "links", "parts", "maybe", "families", "more")

    by_class = classes.select("set_a", "set_b", F.col("n").alias("n_shingles"), F.col("id").alias("node"))
    by_class = by_class.join(parts, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"))
    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the kept documents, all columns; of each component of near duplicates the one of the smallest doc_id.

    Every row is judged by its own text: rows that share a doc_id all stay, unless their texts are near duplicates; of rows
    equal in doc_id and text (by a digest of 256 bits) one stays. Texts without words, nulls, and rows without a doc_id take no part and stay. Any
    further columns are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    key = free_name(docs, "_key")
    keyed, repeated = with_row_keys(docs, key, scratch)
    kept = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent).where("kept").select(F.col("doc_id").alias(key))
    rows = keyed.join(kept, key, "left_semi")
    if repeated:
        firsts = rows.groupBy("doc_id", F.sha2("text", 256)).agg(F.min(key).alias(key)).select(key)  # digests are shuffled, not texts
        rows = rows.join(firsts, key, "left_semi")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))
