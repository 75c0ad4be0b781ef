"""Approximate maximum inner product search with score-aware (anisotropic) quantisation.

Fit, on a bounded sample of rows (`SAMPLE_ROWS`, the first by a hash of vec_id): coarse lists by k-means, and sixteen
codewords for each pair of dimensions of the residual to the list's centre. Codewords and codes minimise
|r|^2 + (eta - 1) <r, x>^2 / |x|^2, which penalises the part of the residual r parallel to the vector x more than the
rest, as it is that part that shifts large inner products. How many lists a query visits, and how much a list's reach
counts beside its centre, is fitted on `CALIBRATED` of the queries themselves: their true neighbours among all rows are found
by brute force, and lists are visited as far as needed to hold `LIST_RECALL` of them.

Search: every row is coded at four bits a dimension pair. Rows of a list are dealt to blocks of at most `BLOCK` rows and
the queries that visit it to chunks of about `CHUNK`, so a list that holds a third of all rows spreads over many tasks. In a
block, codes are scanned with a query's tables, two codes to a byte; the best `RERANK` distinct vectors are scored exactly
in double precision. By how much scores by codes err there, in units of |q| and a row's coding error, bounds the others: all
that may still be among the best are scored exactly too, so lists whose rows hardly differ, or whose scale the codewords
miss, lose none. Each block returns its k best. Equal vectors of a block are scanned once and keep their k
smallest ids. The last step takes the k best of each query over its blocks, with map-side limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoframe.scratch import Scratch

SAMPLE_ROWS = 20_000
BLOCK = 8_192
CHUNK = 1_024
RERANK = 160
THRESHOLD = 0.2  # cosine from which neighbours count, which sets eta
LIST_RECALL = 0.997
CALIBRATED = 256
REACHES = (0.0, 0.1, 0.2, 0.35, 0.5, 1.0)


@dataclass
class Index:
    """Centres (lists x dims), codewords (subspaces x 16 x width), eta, the lists that a query visits, and the weight of reaches."""

    centres: np.ndarray
    words: np.ndarray
    eta: float
    probes: int
    weight: float = 0.0

    @property
    def width(self) -> int:
        return self.words.shape[2]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return np.argmin((self.centres**2).sum(1) - 2 * x @ self.centres.T, axis=1)

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces; the last dimensions are filled with zeros."""
        m, w = self.words.shape[0], self.width
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def codes(self, x: np.ndarray, lists: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        direction = self.padded(x)
        target = self.padded(x - self.centres[lists])
        weight = (self.eta - 1) / np.maximum((x**2).sum(1), 1e-30)
        m = target.shape[1]
        distance = np.empty((m, len(x), 16))
        parallel = np.empty((m, len(x), 16))
        for k in range(m):
            r = target[:, k, None, :] - self.words[k][None]
            distance[k] = (r**2).sum(2)
            parallel[k] = (r * direction[:, k, None, :]).sum(2)
        codes = distance.argmin(2)
        rows = np.arange(len(x))
        total = sum(parallel[k][rows, codes[k]] for k in range(m))
        for _ in range(sweeps):
            for k in range(m):
                rest = total - parallel[k][rows, codes[k]]
                codes[k] = (distance[k] + weight[:, None] * (rest[:, None] + parallel[k]) ** 2).argmin(1)
                total = rest + parallel[k][rows, codes[k]]
        return codes.T.astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each row is from what its codes stand for, and from its list's centre."""
        rest = self.padded(x - self.centres[lists])
        reach = np.sqrt((rest**2).sum((1, 2)))
        for s in range(rest.shape[1]):
            rest[:, s] -= self.words[s][codes[:, s]]
        return np.sqrt((rest**2).sum((1, 2))), reach

    def order(self, queries: np.ndarray, held: np.ndarray, reach: np.ndarray, weight: float) -> np.ndarray:
        """The lists of each query, the most promising first; empty ones last."""
        norms = np.sqrt((queries**2).sum(1))
        hope = queries @ self.centres.T + weight * norms[:, None] * reach
        return np.argsort(-np.where(held > 0, hope, -np.inf), axis=1, kind="stable")

    def calibrate(self, queries: np.ndarray, of: np.ndarray, lists: np.ndarray, held: np.ndarray, reach: np.ndarray) -> None:
        """Fit probes and weight: `lists` hold true neighbours of the queries number `of`. The weight that costs the fewest rows is taken."""
        least = None
        for weight in REACHES if len(of) else ():
            order = self.order(queries, held, reach, weight)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
            probes = int(np.quantile(place[of, lists], LIST_RECALL, method="higher")) + 1
            cost = held[order[:, :probes]].sum()
            if least is None or cost < least:
                least, self.probes, self.weight = cost, probes, weight

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of the codes, the 256 partial inner products."""
        parts = np.einsum("qmw,mcw->qmc", self.padded(queries), self.words)
        if parts.shape[1] % 2:
            parts = np.concatenate([parts, np.zeros((len(parts), 1, 16))], 1)
        low, high = parts[:, ::2], parts[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(parts), -1, 256).astype(np.float32)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit_index(sample: np.ndarray, n_rows: int, width: int = 2, rounds: int = 6, seed: int = 5) -> Index:
    """Fit on a sample of rows for a table of n_rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample.astype(np.float64), axis=0)  # copies would outweigh the rest
    x = x[rng.permutation(len(x))]
    dims = x.shape[1]
    n_lists = int(np.clip(round(n_rows**0.5 / 2), 1, min(1024, max(1, len(x) // 8))))
    centres = _k_means(x, n_lists, rng)
    cosine2 = THRESHOLD**2
    eta = max(1.0, (dims - 1) * cosine2 / (1 - cosine2))
    m = -(-dims // width)
    index = Index(centres, np.zeros((m, 16, width)), eta, n_lists)
    own = index.lists(x)
    target, direction = index.padded(x - centres[own]), index.padded(x)
    for s in range(m):
        picks = rng.choice(len(x), 16, replace=len(x) < 16)
        index.words[s] = target[picks, s] + 1e-9 * rng.standard_normal((16, width))
    norm2 = np.maximum((x**2).sum(1), 1e-30)
    for _ in range(rounds):
        codes = index.codes(x, own, sweeps=1)
        residual = target - index.words[np.arange(m)[None], codes]
        parallel = (residual * direction).sum(2)
        total = parallel.sum(1)
        for s in range(m):
            rest = total - parallel[:, s]
            d, t = direction[:, s], target[:, s]
            pull = t + (eta - 1) * d * ((rest + (t * d).sum(1)) / norm2)[:, None]
            outer = (eta - 1) * d[:, :, None] * d[:, None, :] / norm2[:, None, None]
            for c in range(16):
                mine = codes[:, s] == c
                if mine.any():
                    index.words[s, c] = np.linalg.solve(np.eye(width) * mine.sum() + outer[mine].sum(0), pull[mine].sum(0))
            parallel[:, s] = ((t - index.words[s][codes[:, s]]) * d).sum(1)
            total = rest + parallel[:, s]
    return index


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector that isn't null, zero or partly null or infinite.

    Of repeated ids the smallest vector stays. Extra columns are dropped.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & some).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def search_block(index: Index, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, errors: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best of a block for each query: arrays of query ids, vector ids and exact scores. base: <query, list centre>; errors: how far rows are from
    what their codes stand for."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes, errors = ids[order], vectors[order], codes[order], errors[order]
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    members = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[members], np.arange(len(first) + 1))
    distinct, distinct_codes, errors = vectors[first], codes[first], errors[first]
    norms = np.sqrt((queries**2).sum(1))
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(queries), 64):
        tables = index.tables(queries[lo : lo + 64])
        rough = np.repeat(base[lo : lo + 64, None].astype(np.float32), len(first), axis=1)
        for b in range(distinct_codes.shape[1]):
            rough += tables[:, b, :][:, distinct_codes[:, b]]
        for q in range(len(rough)):
            if len(first) > RERANK:  # k is less
                short = np.argpartition(-rough[q], RERANK)[:RERANK]
            else:
                short = np.arange(len(first))
            scores = (distinct[short] * queries[lo + q]).sum(1)
            if len(first) > RERANK:
                slack = 1e-5 * float(np.abs(rough[q]).max())  # codes are summed in single precision
                unit = norms[lo + q] * errors
                share = min(1.0, float((np.maximum(np.abs(scores - rough[q][short]) - slack, 0) / np.maximum(unit[short], 1e-300)).max()))
                least = -np.partition(-scores, k)[k]
                near = rough[q] + share * unit + slack >= least
                near[short] = False
                more = np.flatnonzero(near)
                short, scores = np.concatenate([short, more]), np.concatenate([scores, (distinct[more] * queries[lo + q]).sum(1)])
            best = short[np.lexsort((ids[first[short]], -scores))]
            exact = np.sort(-scores)
            found = 0
            taken_ids, taken_scores = [], []
            for place, score in zip(best, -exact, strict=True):
                if found >= k and score < taken_scores[k - 1]:
                    break
                own = ids[members[cuts[place] : min(cuts[place + 1], cuts[place] + k + 1)]]
                own = own[own != query_ids[lo + q]][:k]
                taken_ids.append(own)
                taken_scores += [score] * len(own)
                found += len(own)
            if found:
                all_ids, all_scores = np.concatenate(taken_ids), np.array(taken_scores)
                top = np.lexsort((all_ids, -all_scores))[:k]
                out[0].append(np.full(len(top), query_ids[lo + q]))
                out[1].append(all_ids[top])
                out[2].append(all_scores[top])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest_by_inner_product(embeddings: DataFrame, every: int = 20, k: int = 20, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, the k rows found with the largest inner product.

    Columns: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. A query is never its own neighbour; with
    fewer candidates than k in the table all are returned. Vectors whose length differs from the longest take no part.
    An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "inner-product")
    rows = scratch.table(usable_vectors(embeddings), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == size.dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    index = fit_index(_matrix(sample.column(0)), size.n)
    n_lists, dims = len(index.centres), size.dims

    def code(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column(1))
                own = index.lists(x)
                codes = index.codes(x, own)
                error, reach = index.errors(x, own, codes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in index.packed(codes)], pa.binary()), pa.array(error), pa.array(reach), part.column(1)], ["vec_id", "list", "codes", "error", "reach", "vector"])

    coded = scratch.table(rows.mapInArrow(code, "vec_id long, list int, codes binary, error double, reach double, vector array<double>"), "coded")
    held, reach = np.zeros(n_lists, np.int64), np.zeros(n_lists)
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect():  # one row a list, 1,024 at most
        held[r["list"]], reach[r["list"]] = r["n"], r["reach"]
    queries = rows.where(F.col("vec_id") % every == 0)
    known = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATED).toArrow()
    known_ids, known_x = known["vec_id"].to_numpy(), _matrix(known["vector"])

    def truth(batches):
        scores, lists = np.full((len(known_ids), k), -np.inf), np.zeros((len(known_ids), k), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                products = known_x @ _matrix(part.column(2)).T
                products[known_ids[:, None] == part.column(0).to_numpy()[None]] = -np.inf
                both = np.hstack([scores, products])
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                scores = np.take_along_axis(both, best, axis=1)
                lists = np.take_along_axis(np.hstack([lists, np.broadcast_to(part.column(1).to_numpy(), products.shape)]), best, axis=1)
        q, c = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(lists[q, c]), pa.array(scores[q, c])], ["q", "list", "score"])

    if len(known_ids):
        found = coded.select("vec_id", "list", "vector").mapInArrow(truth, "q long, list long, score double")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))
        true = found.withColumn("r", place).where(F.col("r") <= k).select("q", "list").toArrow()  # k a calibrated query
        index.calibrate(known_x, true["q"].to_numpy(), true["list"].to_numpy(), held, reach)
    blocks = np.maximum(1, -(-held // BLOCK))

    def visit(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            products = x @ index.centres.T
            order = index.order(x, held, reach, index.weight)
            enough = (np.cumsum(held[order], axis=1) <= 4 * k).sum(1) + 1
            count = np.minimum(n_lists, np.maximum(enough, index.probes))
            q = np.repeat(np.arange(len(x)), count)
            lists = order[np.arange(n_lists)[None] < count[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(lists.astype(np.int32)), pa.array(products[q, lists])], ["query_id", "list", "base"])

    visits = scratch.table(queries.mapInArrow(visit, "query_id long, list int, base double"), "visits")
    asked = np.zeros(n_lists, np.int64)
    for r in visits.groupBy("list").count().collect():
        asked[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-asked // CHUNK))
    deal = spark.createDataFrame([(k_, int(b), int(c)) for k_, (b, c) in enumerate(zip(blocks, chunks, strict=True)) if held[k_] and asked[k_]], "list int, blocks int, chunks int")
    left = (
        coded.join(F.broadcast(deal), "list")  # one row a list
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("list", "block", "chunk", "vec_id", "codes", "error", "vector")
    )
    right = (
        visits.join(F.broadcast(deal), "list")
        .join(queries.withColumnRenamed("vec_id", "query_id"), "query_id")
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("list", "block", "chunk", "query_id", "base", "vector")
    )

    def scan(rows_: pa.Table, asks: pa.Table) -> pa.Table:
        found: tuple = (np.zeros(0),) * 3
        if rows_.num_rows and asks.num_rows:
            codes = np.frombuffer(b"".join(rows_["codes"].to_pylist()), np.uint8).reshape(rows_.num_rows, -1)
            found = search_block(index, rows_["vec_id"].to_numpy(), _matrix(rows_["vector"]), codes, rows_["error"].to_numpy(), asks["base"].to_numpy(), asks["query_id"].to_numpy(), _matrix(asks["vector"]), k)
        q, v, s = found
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    keys = ("list", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
