"""Ranked lexical search by a document FP-tree with branch and bound.

The terms of the query items, in blocks of items of a bounded size, restrict every document to a vector of the block's
terms. Ordered from the most frequent term to the rarest, the vectors are paths, and documents that begin alike share the
path of a prefix tree. Documents are dealt to shards by ranges of paths, so that a shard is a subtree or a few; a shard's
tree is held in arrays. Every node knows the largest frequency of each term in its subtree, the least m and the least
doc_id. For an item, the score of a document with these values bounds all scores below a node; the tree is searched depth
first, the most promising child first, and subtrees that can't reach the best found so far are cut. What the shards find
is merged for each item, in two steps.

Everything but a term's weight is in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoframe.scratch import Scratch

#: Letters, digits and all bytes from 0x80 on are in terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
ITEM_BYTES = 16_000_000  # of item texts in a block, whose terms every task holds
TREE_POSTINGS = 1_000_000
LEAF = 32  # documents that are scored together
MERGE = 64  # shards whose rows meet in the first merge


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; terms are numbers of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            kept, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                counts = Counter(map(number, found))
                counts.pop(None, None)
                kept.append(k)
                sizes.append(len(found))
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            columns = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _paths(vectors: DataFrame, place, documents: int, total: int) -> DataFrame:
    """(doc_id, m, path, tfs): vectors in the order of frequency; a path is its places, four bytes each, high byte first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, tfs = batch.column(2), batch.column(3).flatten().to_numpy()
            cuts = lists.offsets.to_numpy()
            at = place.value[lists.flatten().to_numpy()]
            of = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            order = np.lexsort((at, of))
            raw = at[order].astype(">u4").tobytes()
            cuts = cuts - cuts[0]
            paths = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            m = [50 + 50 * n * documents // total for n in batch.column(1).to_pylist()]
            sorted_tfs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tfs[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.int64()), pa.array(paths, pa.binary()), sorted_tfs], ["doc_id", "m", "path", "tfs"])

    return vectors.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "doc_id long, m long, path binary, tfs array<long>")


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the largest value of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.maximum.reduceat(values, first)


class Tree:
    """The FP-tree of documents in the order of their paths, without nodes of one child.

    Nodes are numbered so that a node's children follow each other. A subtree of LEAF documents or fewer, or several beside
    each other, is a leaf. bounds() is over `keys`, node * terms + term, and `tops`, the largest frequency in the subtree.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, paths: list[bytes], tfs: np.ndarray, terms: int):
        self.ids, self.m, self.tf, self.terms = ids, m, tfs, terms
        self.cuts = np.zeros(len(paths) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in paths], out=self.cuts[1:])
        self.term = np.frombuffer(b"".join(paths), ">u4").astype(np.int64)
        self.of = np.repeat(np.arange(len(paths)), np.diff(self.cuts))
        alike = self._common()
        ranges, first, count = [(0, len(paths))], [0], [0]
        node = 0
        while node < len(ranges):
            lo, hi = ranges[node]
            if hi - lo > LEAF:
                inner = alike[lo + 1 : hi]
                edges = np.concatenate([[lo], lo + 1 + np.flatnonzero(inner == inner.min()), [hi]]).tolist()
                children, at = [], lo
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b - at > LEAF and a > at:  # what is held so far is a leaf
                        children.append((at, a))
                        at = a
                    if b - at > LEAF:
                        children.append((at, b))
                        at = b
                if at < hi:
                    children.append((at, hi))
                first[node], count[node] = len(ranges), len(children)
                ranges += children
                first += [0] * len(children)
                count += [0] * len(children)
            node += 1
        self.ranges, self.first, self.count = ranges, first, count
        n = len(ranges)
        self.least_m, self.least_id = (np.array([v[a:b].min() for a, b in ranges], np.int64) for v in (m, ids))
        own: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], self.ids[:0])] * n
        for k in range(n - 1, -1, -1):  # children come after their parents
            some = range(first[k], first[k] + count[k])
            a, b = self.cuts[ranges[k][0]], self.cuts[ranges[k][1]]
            own[k] = _largest(*(np.concatenate([own[c][v] for c in some]) for v in (0, 1))) if count[k] else _largest(self.term[a:b], tfs[a:b])
        self.keys = np.concatenate([x + k * terms for k, (x, _) in enumerate(own)])
        self.tops = np.concatenate([x for _, x in own])

    def _common(self) -> np.ndarray:
        """For each document, the terms at the start of its path that the one before has too."""
        out = np.zeros(len(self.cuts) - 1, np.int64)
        for k in range(1, len(out)):
            a, b, c = self.cuts[k - 1], self.cuts[k], self.cuts[k + 1]
            size = min(b - a, c - b)
            other = np.flatnonzero(self.term[a : a + size] != self.term[b : b + size])
            out[k] = other[0] if len(other) else size
        return out

    def bounds(self, nodes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """No document below a node scores more."""
        want = nodes[:, None] * self.terms + term
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        tf = np.where(self.keys[at] == want, self.tops[at], 0)
        return _scores(weight, tf, self.least_m[nodes][:, None]).sum(1)

    def search(self, term: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids), best first, of those given and those of the tree. slot: -1 for each term, left so."""
        scores, ids = best
        slot[term] = np.arange(len(term))
        stack = [(int(self.bounds(np.zeros(1, np.int64), term, weight)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if not bound or len(scores) == k and (bound < scores[-1] or bound == scores[-1] and self.least_id[node] >= ids[-1]):
                continue
            if self.count[node]:
                children = np.arange(self.first[node], self.first[node] + self.count[node])
                found = self.bounds(children, term, weight)
                order = np.argsort(found, kind="stable")
                order = order[found[order] >= (scores[-1] if len(scores) == k else 1)]
                stack += zip(found[order].tolist(), children[order].tolist(), strict=True)
                continue
            lo, hi = self.ranges[node]
            a, b = self.cuts[lo], self.cuts[hi]
            place = slot[self.term[a:b]]
            hit = np.flatnonzero(place >= 0)
            of = self.of[a:b][hit]
            own = np.zeros(hi - lo, np.int64)
            np.add.at(own, of - lo, _scores(weight[place[hit]], self.tf[a:b][hit], self.m[of]))
            some = np.flatnonzero(own >= (scores[-1] if len(scores) == k else 1))
            if len(some):
                scores, ids = np.concatenate([scores, own[some]]), np.concatenate([ids, self.ids[lo:hi][some]])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
        slot[term] = -1
        return scores, ids


def _scores(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _trees(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[Tree]:
    """Trees over consecutive rows of about TREE_POSTINGS places each."""
    ids, m, paths, tfs, held = [], [], [], [], 0

    def tree() -> Tree:
        return Tree(np.concatenate(ids), np.concatenate(m), paths, np.concatenate(tfs), terms)

    for batch in batches:
        at = 0
        own = batch.column(2).to_pylist()
        sizes = np.cumsum([len(p) // 4 for p in own])
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = min(batch.num_rows, int(np.searchsorted(sizes, before + TREE_POSTINGS - held)) + 1)
            some = batch.slice(at, end - at)
            ids.append(some.column(0).fill_null(_NO_ID).to_numpy())
            m.append(some.column(1).to_numpy())
            paths += own[at:end]
            tfs.append(some.column(3).flatten().to_numpy())
            held += int(sizes[end - 1] - before)
            at = end
            if held >= TREE_POSTINGS:
                yield tree()
                ids, m, paths, tfs, held = [], [], [], [], 0
    if paths:
        yield tree()


_NO_ID = np.iinfo(np.int64).max  # a document without an id comes last among ties


def _searched(items, terms: int, k: int):
    """(item, doc_id, score): the k best of a task's documents for each item (number, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = {}
        slot = np.full(terms, -1, np.int64)
        for tree in _trees(batches, terms):
            for number, term, weight in items.value:
                found[number] = tree.search(term, weight, found.get(number, (none, none)), k, slot)
        for number, (scores, ids) in found.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int64)), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame) -> list[DataFrame]:
    """The items by hash, in as many blocks as their bytes need."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(block == k) for k in range(blocks)]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties to the smaller doc_id.

    Each row of `items` is an item, each row of `docs` a document, repeated rows too; null and empty texts have no terms, so
    such items have no rows and such documents aren't counted. A document without a doc_id is ranked, last among ties. Empty
    tables give no rows. Extra columns of either table are dropped, whatever their names. Items go block by block, each
    block once over all documents.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in _item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        if (found := _ranked_block(docs, some, k)) is not None:
            out = out.unionByName(found)
    return out


def _ranked_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = [(r.item_id, sorted(set(terms_of(r.text)))) for r in items.collect()]  # a block of bounded bytes
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, some in asked for t in some}))}
    if not vocabulary:
        return None
    vectors = scratch.table(_vectors(docs, spark.sparkContext.broadcast(vocabulary)), "vectors")
    whole = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("total"), F.sum(F.size("terms")).alias("postings")).first()
    if not whole.postings:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r.t] = r["count"]
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    numbered = []
    for number, (_, some) in enumerate(asked):
        own = np.array([vocabulary[t] for t in some if df[vocabulary[t]]], np.int64)
        if len(own):
            numbered.append((number, place[own], weights[own]))
    paths = scratch.table(_paths(vectors, spark.sparkContext.broadcast(place), whole.documents, whole.total), "paths")
    shards = max(1, math.ceil(whole.postings / TREE_POSTINGS))
    dealt = paths.withColumn("start", F.substring("path", 1, 64)).withColumn("tie", F.xxhash64("doc_id", "m", "path")).repartitionByRange(shards, "start", "tie")
    dealt = dealt.sortWithinPartitions("path").select("doc_id", "m", "path", "tfs")
    found = dealt.mapInArrow(_searched(spark.sparkContext.broadcast(numbered), len(vocabulary), k), "item long, doc_id long, score long")
    found = scratch.table(found.withColumn("part", (F.spark_partition_id() / MERGE).cast("int")), "found")
    order = [F.col("score").desc(), F.col("doc_id")]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], "item long, item_id long")
    scratch.drop("vectors", "paths")
    doc_id = F.when(F.col("doc_id") != int(_NO_ID), F.col("doc_id")).alias("doc_id")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
