"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Fingerprints that differ in `bits` bits at most share `8 - bits` of them
at least, the guaranteed minimum of matches. The index has a posting list for each positional byte; lists are read where
they meet, so that they stay short: of the guaranteed matches, half at least lie in one half of the positions, so a pair
meets in the meeting of that many lists there (three bytes for three bits, eight such tables). A meeting of more than
BLOCK fingerprints is met with one more positional byte, in `bits + 1` of the positions left: the matches still owed
can't all lie elsewhere. What is large even with all guaranteed bytes equal is dealt in pairs of blocks to tasks.

In a list, the shared positional bytes of each pair are tallied; pairs with the guaranteed minimum are verified bit by
bit. Tasks return which fingerprints belong together, never pairs of a whole list; components come from these links. Only
distinct fingerprints are searched, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoframe.llm.near_dedup import _groups, _joined
from histoframe.operators.components import connected_components
from histoframe.scratch import Scratch

SEED = 42
BLOCK = 1024
SLICE = 200_000  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int) -> int:
    """64 bits, unsigned: each is set where over half the shingle hashes have it; zero for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    raw = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(first[at : at + SLICE], last[at : at + SLICE], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _byte_mask(positions: int) -> int:
    """The bits of the chosen byte positions, as a signed long."""
    mask = sum(0xFF << 8 * p for p in range(8) if positions >> p & 1)
    return mask - (1 << 64) if mask >> 63 else mask


def _lists(fp: Column, choices: list[int]) -> Column:
    """(positions, bytes) of the posting lists of a fingerprint for the chosen sets of positions."""
    return F.array(*(F.struct(F.lit(p).alias("positions"), fp.bitwiseAND(F.lit(_byte_mask(p))).alias("bytes")) for p in choices))


def _finer(positions: int, more: int) -> list[int]:
    """The first `more` of the positions left, each added to the chosen ones."""
    return [positions | 1 << p for p in range(8) if not positions >> p & 1][:more]


def posting_lists(fps: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(positions, bytes, lo, hi, side, fp): short posting lists, and block pairs of those that can't be made shorter."""
    owed = 8 - bits
    size = math.ceil(owed / 2)
    halves = [sum(1 << p for p in some) for half in (range(4), range(4, 8)) for some in combinations(half, size)]
    rows = fps.select("fp", F.explode(_lists(F.col("fp"), halves)).alias("l")).select("l.positions", "l.bytes", "fp")
    one = [F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(2).alias("side")]
    out = None
    for level in range(size, owed + 1):
        counts = rows.groupBy("positions", "bytes").agg(F.count("*").alias("c")).where("c > 1")
        met = scratch.table(rows.join(counts, ["positions", "bytes"]), f"lists-{level}")
        short = met.where(F.col("c") <= BLOCK).select("positions", "bytes", *one, "fp")
        out = short if out is None else out.unionByName(short)
        long = met.where(F.col("c") > BLOCK)
        if level == owed:
            blocks = F.ceil(F.col("c") / BLOCK).cast("int")
            dealt = long.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
            out = out.unionByName(dealt.select("positions", "bytes", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "fp"))
            break
        sets = [r.positions for r in long.select("positions").distinct().collect()]  # 2^8 at most
        if not sets:
            break
        finer = F.lit(None)
        for p in sets:
            finer = F.when(F.col("positions") == p, _lists(F.col("fp"), _finer(p, bits + 1))).otherwise(finer)
        rows = long.select("fp", F.explode(finer).alias("l")).select("l.positions", "l.bytes", "fp").distinct()
    return out


def _tallied(bits: int):
    """Fingerprints that belong together: by tallies of shared positional bytes, then bit by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("positions", "bytes", "lo", "hi")):
            fps, sides = rows["fp"].to_numpy(), rows["side"].to_numpy()
            x, y = fps[sides != 1], fps[sides != 0]  # 2: both sides of a block with itself
            left, right = (v.view(np.uint8).reshape(-1, 8) for v in (np.ascontiguousarray(x), np.ascontiguousarray(y)))
            shared = np.zeros((len(x), len(y)), np.uint8)
            for k in range(8):
                shared += left[:, k][:, None] == right[:, k][None]
            linked = shared >= 8 - bits
            i, j = np.nonzero(linked)
            linked[i, j] = np.bitwise_count((x[i] ^ y[j]).view(np.uint64)) <= bits  # of signed numbers it counts the absolute value
            a, b = _joined(linked, x, y)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def simhash_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable.

    Fingerprints are linked where they differ in `bits` bits (0 to 7) at most. Texts without words, nulls among them, have the
    fingerprint zero and are linked like any other. Equal rows, and rows that share a doc_id, each keep their own row and text.
    A row without a doc_id links texts like any other, and gets the smallest doc_id that it reaches, null if none. An empty
    table gives no rows. Extra columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # lists are heavy, whatever their bytes
    found = scratch.table(fingerprints(docs, words), "fingerprints")
    classes = scratch.table(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    keys = ("positions", "bytes", "lo", "hi")
    lists = posting_lists(classes.select("fp"), bits, scratch).repartition(parts, *keys).sortWithinPartitions(*keys)
    links = scratch.table(lists.mapInArrow(_tallied(bits), "a long, b long").distinct(), "links")
    joined = scratch.table(connected_components(links, scratch, "components").toDF("fp", "component"), "joined")
    placed = classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = scratch.table(placed.join(ids, "component").select("fp", "component_id"), "by-fp")
    scratch.drop("classes", "links", "joined", *(f"lists-{k}" for k in range(9)))
    return found.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
