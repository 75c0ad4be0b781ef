"""Hierarchical multi-length packing of documents into training sequences.

Every document is routed by its length: whole windows of the longest tier are cut off its front, and the rest goes to the
shortest tier that holds it. A tier packs its pieces largest first into the fullest sequence with room. The gaps that are
left are filled from shorter tiers: first with whole pieces, then with the front of a piece, whose rest moves to its own
tier. The last sequence of a block, which nothing is left to fill, is cut at powers of two, so that no sequence needs
padding. Sequences of a tier are dealt to step groups whose tokens differ by one sequence at most.

Blocks of documents are packed one by one inside the tasks that scan them, so nothing is shuffled and memory is bounded
by `block_docs` and `block_tokens`.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.encoder import encoder

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 16 * 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length)]) for documents of the given lengths; each token lies in one piece."""
    top = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending

    def route(length: int, doc: int, start: int) -> None:
        insort(waiting[tiers[bisect_left(tiers, length)]], (length, doc, start))

    for doc, n in enumerate(lengths):
        whole = n // top
        out += [(top, [(doc, k * top, top)]) for k in range(whole)]
        if n % top:
            waiting[tiers[bisect_left(tiers, n % top)]].append((n % top, doc, whole * top))
    for pieces in waiting.values():
        pieces.sort()
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        while waiting[tier]:
            length, doc, start = waiting[tier].pop()
            pieces, room = [(doc, start, length)], tier - length
            while room:
                best = None
                for t in tiers[k::-1]:  # its own tier first, then shorter ones
                    at = bisect_left(waiting[t], (room + 1, -1, -1))
                    if at:
                        best = (t, at - 1)
                        break
                if best is None:
                    t = next((t for t in tiers if waiting[t]), None)
                    if t is None or t > tier:
                        break
                    length, doc, start = waiting[t].pop(0)
                    pieces.append((doc, start, room))
                    route(length - room, doc, start + room)
                    room = 0
                else:
                    length, doc, start = waiting[best[0]].pop(best[1])
                    pieces.append((doc, start, length))
                    room -= length
            out += [(tier, pieces)] if not room else _at_powers(pieces)
    return out


def _at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """A sequence that nothing is left to fill, cut into sequences of powers of two, which need no padding."""
    pieces, left = pieces[::-1], sum(p[2] for p in pieces)
    while left:
        size = room = 1 << left.bit_length() - 1
        some = []
        while room:
            doc, start, length = pieces.pop()
            if length > room:
                pieces.append((doc, start + room, length - room))
                length = room
            some.append((doc, start, length))
            room -= length
        left -= size
        yield size, some


def step_groups(sizes: list[int], tiers: tuple[int, ...], step_tokens: int) -> tuple[list[tuple[int, int]], int]:
    """(tier, group) of each sequence and the number of groups: sequences go by tier, largest first, to the group with the
    fewest tokens, so that two groups of a tier differ by one sequence at most."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    made = 0
    for tier in tiers:
        own = [k for k, n in enumerate(sizes) if tiers[bisect_left(tiers, n)] == tier]
        n = -(-sum(sizes[k] for k in own) // step_tokens)
        heap = [(0, made + g) for g in range(n)]
        for k in sorted(own, key=lambda k: -sizes[k]):
            filled, group = heap[0]
            out[k] = (tier, group)
            heapq.heapreplace(heap, (filled + sizes[k], group))
        made += n
    return out, made


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, block_docs: int = 20_000, block_tokens: int = 8_000_000) -> DataFrame:
    """Pieces of packed sequences, one row each, for the ids of every (doc_id, text) followed by `end_id`.

    Null texts are empty: their only token is the end id. Repeated rows are packed as often as they occur and null ids
    stay null. `offset` is the place in the sequence; `sequence_id` is unique over the table; `tier` is the context size
    that the sequence was packed for and `step_group` numbers groups of about `step_tokens` tokens of one tier, which
    within a block differ by one sequence at most.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        next_id, next_group = (TaskContext.get().partitionId() << 40 for _ in range(2))

        def flush(doc_ids: list, parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
            nonlocal next_id, next_group
            raw = np.concatenate(parts).astype("<u4").tobytes()
            places = ((np.cumsum(counts) - counts) * 4).tolist()
            lengths = counts.tolist()
            sequences = pack_lengths(lengths, tiers)
            groups, made = step_groups([sum(p[2] for p in pieces) for _, pieces in sequences], tiers, step_tokens)
            columns: list[list] = [[] for _ in range(9)]
            for (_, pieces), (tier, group) in zip(sequences, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    at = places[doc] + 4 * start
                    row = (doc_ids[doc], start, length, zlib.crc32(raw[at : at + 4 * length]), lengths[doc], next_id, offset, tier, next_group + group)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                next_id += 1
            next_group += made
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int32() if n == "tier" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        doc_ids: list = []
        parts: list[np.ndarray] = []
        counted: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, ids, counts in enc.encode_column(batch.column(1), end_id):
                doc_ids += own[at : at + len(counts)]
                parts.append(ids)
                counted.append(counts)
                held += len(ids)
                if len(doc_ids) >= block_docs or held >= block_tokens:
                    yield flush(doc_ids, parts, np.concatenate(counted))
                    doc_ids, parts, counted, held = [], [], [], 0
        if doc_ids:
            yield flush(doc_ids, parts, np.concatenate(counted))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)
