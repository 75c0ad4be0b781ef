"""Rounds of community moves over a graph whose links stay where they are.

Nodes are numbered, and each task has the links of a range of them as files. What changes from round to round is a row a node, which
every task reads whole, as a broadcast join would: so a round shuffles nothing, and is one small job. Graphs of more nodes than a
task should hold take the rounds of joins in neighbors.py. A column is a file of numbers for each range, in the order of the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.operators.parts import numbered
from histoframe.scratch import Scratch, open_fs, write_file

NODES = 8_192  # of a range, at least
KINDS = {"c": np.int64, "part": np.int64, "turns": np.int64, "k": float, "ties": float, "out": float}


def _column(files: list[str], *names: str) -> list[np.ndarray]:
    """Columns of a table from its files, in their order."""
    tables = []
    for uri in files:
        file_system, path = open_fs(uri)
        with file_system.open_input_file(path) as source:
            tables.append(pq.read_table(source, columns=list(names)))
    whole = pa.concat_tables(tables)
    return [whole[n].to_numpy() for n in names]


def _read(uri: str, ranges: int, name: str) -> np.ndarray:
    """A column of all nodes."""
    file_system, path = open_fs(uri)
    parts = []
    for p in range(ranges):
        with file_system.open_input_file(f"{path}/{p}.{name}") as source:
            parts.append(np.frombuffer(source.read(), KINDS[name]))
    return np.concatenate(parts)


def _links(uri: str, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    file_system, path = open_fs(f"{uri}/p={p}")
    tables = []
    for f in sorted(f.path for f in file_system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")):
        with file_system.open_input_file(f) as source:
            tables.append(pq.ParquetFile(source).read(["ia", "ib", "w"]))
    if not tables:  # a range of nodes that have loops only
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    whole = pa.concat_tables(tables)
    return tuple(whole[c].to_numpy() for c in ("ia", "ib", "w"))


def _options(a: np.ndarray, to: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, group, weight) in this order, from links of nodes to groups."""
    order = np.lexsort((to, a))
    a, to, w = a[order], to[order], w[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (to[1:] != to[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], to[at], np.add.reduceat(w, at) if len(at) else w


def _greatest(a: np.ndarray, to: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its option of greatest gain, the smaller group of equals; options in the order of node and group."""
    if not len(a):
        return a, to, gain
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    best = np.repeat(np.maximum.reduceat(gain, at), np.diff(np.append(at, len(a)))) == gain
    first = np.flatnonzero(best)
    node, k = np.unique(a[first], return_index=True)
    return node, to[first[k]], gain[first[k]]


def moved(c: np.ndarray, k: np.ndarray, turn: np.ndarray, lo: int, hi: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, ...]:
    """(c, wants, inner, mass) of nodes lo to hi, whose links are a, b, w: those whose turn it is go to the community of greatest gain."""
    mass = np.bincount(c, k, len(c))
    node, to, links = _options(a, c[b], w)
    own = to == c[node]
    inner = np.zeros(hi - lo)
    inner[node[own] - lo] = links[own]
    now = c[lo:hi]
    stay = np.round(inner - resolution * k[lo:hi] * (mass[now] - k[lo:hi]) / (2 * total), 9)
    node, to, links = node[~own], to[~own], links[~own]
    node, to, gain = _greatest(node, to, np.round(links - resolution * k[node] * mass[to] / (2 * total), 9))
    better = gain > stay[node - lo]
    wants, after = np.zeros(hi - lo, bool), now.copy()
    wants[node[better] - lo] = True
    goes = better & turn[node]
    after[node[goes] - lo] = to[goes]
    return after, wants, inner, mass[now]


def cut_links(c: np.ndarray, part: np.ndarray, lo: int, hi: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ties, out): a node's links within its community, and those of them that leave its part."""
    same = c[a] == c[b]
    leave = same & (part[a] != part[b])
    return np.bincount(a[same] - lo, w[same], hi - lo), np.bincount(a[leave] - lo, w[leave], hi - lo)


def joined(c: np.ndarray, k: np.ndarray, turn: np.ndarray, part: np.ndarray, ties: np.ndarray, out: np.ndarray, lo: int, hi: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """The parts of nodes lo to hi after those that are alone, well connected and at turn have joined a well connected part."""
    n = len(c)
    whole = np.bincount(c, k, n)[c]  # a part is named by one of its nodes
    size, mass, cut = np.bincount(part, minlength=n), np.bincount(part, k, n), np.bincount(part, out, n)

    def enough(links: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (links > 0) & (links + 1e-9 >= resolution * k * (whole - k) / (2 * total))

    open_ = enough(cut, mass) & ((size > 1) | ~turn)
    movers = enough(ties, k) & (part == np.arange(n)) & (size == 1) & turn
    some = movers[a] & (c[a] == c[b]) & (part[a] != part[b])
    node, to, links = _options(a[some], part[b[some]], w[some])
    gain = np.round(links - resolution * k[node] * mass[to] / (2 * total), 9)
    good = open_[to] & (gain > 0)
    node, to, _ = _greatest(node[good], to[good], gain[good])
    after = part[lo:hi].copy()
    after[node - lo] = to
    return after


class Graph:
    """A level's links (a, b, w), both ways and without loops, by ranges of the numbers of their nodes; degree: (node, k).

    start: communities (node, c) to begin with; without, a node is one.
    """

    def __init__(self, links: DataFrame, degree: DataFrame, total: float, resolution: float, scratch: Scratch, level: int, start: DataFrame | None):
        self.scratch, self.level, self.total, self.resolution = scratch, level, total, resolution
        self.spark = degree.sparkSession
        self.n = degree.count()
        wanted = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.ranges = max(1, min(wanted, -(-self.n // NODES)))
        self.width = -(-self.n // self.ranges)
        numbers = numbered(degree, ["node"], f"node-{level}", scratch)
        self.numbers = scratch.table(numbers.select("node", (F.col(f"node-{level}") - 1).alias("i")), f"numbers-{level}")
        self.begun = self._begun(degree, start)
        a, b = (self.numbers.toDF(name, f"i{name}") for name in "ab")
        rows = links.join(a, "a").join(b, "b").select((F.col("ia") / self.width).cast("int").alias("p"), "ia", "ib", "w")
        self.links = scratch.path(f"links-of-{level}")
        rows.repartition(self.ranges, "p").sortWithinPartitions("p", "ia", "ib").write.partitionBy("p").option("compression", "zstd").parquet(self.links)

        self.each("begin", lambda lo, hi, _, s: ({c: s[c][lo:hi] for c in ("c", "k", "turns")}, ()), {})

    def _begun(self, degree: DataFrame, start: DataFrame | None) -> list[str]:
        rows = self.numbers.join(degree, "node")
        if start is None:
            rows = rows.withColumn("c", F.col("i"))
        else:
            named = rows.join(start, "node").withColumnRenamed("c", "old")
            rows = named.join(named.groupBy("old").agg(F.min("i").alias("c")), "old")
        rows = rows.select("i", "c", "k", F.xxhash64("node").alias("turns"))
        return sorted(self.scratch.table(rows.orderBy("i"), f"begin-{self.level}").inputFiles())

    def each(self, name: str, work: Callable, reads: dict[str, tuple[str, ...]]) -> list[float]:
        """Columns that work(lo, hi, links, columns) gives for each range, written as `name`; the sums of the numbers that it tells."""
        n, width, ranges, links, begun = self.n, self.width, self.ranges, self.links, self.begun
        uris, into = {self.folder(k): names for k, names in reads.items()}, self.scratch.folder(f"nodes-{self.level}/{name}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch["id"].to_pylist():
                    lo, hi = min(n, p * width), min(n, (p + 1) * width)
                    columns = {c: _read(uri, ranges, c) for uri, names in uris.items() for c in names}
                    columns = columns or dict(zip(("c", "k", "turns"), _column(begun, "c", "k", "turns")))
                    found, told = work(lo, hi, _links(links, p), columns)
                    for c, v in found.items():
                        write_file(f"{into}/{p}.{c}", lambda out, v=v, c=c: out.write(np.ascontiguousarray(v, KINDS[c]).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([[float(v) for v in told]], pa.list_(pa.float64()))], ["p", "told"])

        told = self.spark.range(0, ranges, 1, ranges).mapInArrow(run, "p long, told array<double>").collect()  # a row a range
        return [math.fsum(v) for v in zip(*(r.told for r in sorted(told)))]

    def folder(self, name: str) -> str:
        return self.scratch.path(f"nodes-{self.level}/{name}")

    def settled(self, loops: float, calm: int, patience: int) -> str:
        """The name of the state when no node wants to move, or the modularity hasn't risen for `patience` rounds; loops: the weight of links to oneself."""
        r, best, state, held, worse, total, resolution = 0, None, "begin", "begin", 0, self.total, self.resolution
        while True:

            def work(lo, hi, links, s, r=r):
                after, wants, inner, mass = moved(s["c"], s["k"], (s["turns"] >> (r % 64)) & 1 == 1, lo, hi, *links, total, resolution)
                return {"c": after}, (wants.sum(), inner.sum(), (s["k"][lo:hi] * mass).sum())

            wants, inner, square = self.each(f"state-{r}", work, {"begin": ("k", "turns"), state: ("c",)} if state != "begin" else {state: ("c", "k", "turns")})
            if r >= calm:
                now = (inner + 2 * loops) / (2 * total) - resolution * square / (2 * total) ** 2
                if best is None or now > best + 1e-9:
                    best, old, held, worse = now, held, state, 0
                    self.drop(old, state)
                else:
                    worse += 1
                    if worse == patience:
                        return held
            if not wants:
                return state
            if state != held:
                self.drop(state, held)
            state, r = f"state-{r}", r + 1

    def drop(self, name: str, kept: str) -> None:
        if name not in ("begin", kept):
            self.scratch.drop(f"nodes-{self.level}/{name}")

    def refined(self, state: str) -> str:
        """The name of parts of communities, grown from single nodes; nodes that have joined stay, so the rounds end."""
        total, resolution, t, still, part = self.total, self.resolution, 0, 0, "parts"
        self.each(part, lambda lo, hi, links, s: ({"part": np.arange(lo, hi)}, ()), {state: ("c",)})
        own = {"begin": ("k", "turns"), state: ("c",)} if state != "begin" else {state: ("c", "k", "turns")}
        while still < 2:

            def cuts(lo, hi, links, s):
                return dict(zip(("ties", "out"), cut_links(s["c"], s["part"], lo, hi, *links))), ()

            def work(lo, hi, links, s, t=t):
                after = joined(s["c"], s["k"], (s["turns"] >> ((t + 32) % 64)) & 1 == 1, s["part"], s["ties"], s["out"], lo, hi, *links, total, resolution)
                return {"part": after}, ((after != s["part"][lo:hi]).sum(),)

            self.each(f"cuts-{t}", cuts, {state: ("c",), part: ("part",)})
            (went,) = self.each(f"parts-{t}", work, own | {part: ("part",), f"cuts-{t}": ("ties", "out")})
            self.drop(f"cuts-{t}", "")
            self.drop(part, "")
            part, still = f"parts-{t}", 0 if went else still + 1
            t += 1
        return part

    def named(self, state: str, part: str | None = None) -> DataFrame:
        """(node, c, part): communities and parts, by numbers of this level; without parts a community is its own."""
        n, width, ranges = self.n, self.width, self.ranges
        uris = [(self.folder(state), "c"), (self.folder(part or state), "part" if part else "c")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch["id"].to_pylist():
                    lo, hi = min(n, p * width), min(n, (p + 1) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), *(pa.array(_read(uri, ranges, c)[lo:hi]) for uri, c in uris)], ["i", "c", "part"])

        found = self.spark.range(0, ranges, 1, ranges).mapInArrow(run, "i long, c long, part long")
        return self.numbers.join(found, "i").select("node", "c", "part")
