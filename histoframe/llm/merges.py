"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct chunks of the whole corpus are gathered by their hashes into shards. In a shard the words of its chunks (the
matches of the split pattern, each distinct word once) lie one after another as byte tokens. An inverted index lists, for each mergeable pair, the positions in the words where it stands. The pairs are
replayed in rank order over all words at once; a merge touches its two neighbours only, whose new pairs enter the index.
Pairs with the same joined bytes have the same rank and are replayed together, from left to right in a word. If a merge
makes a pair of a lower rank, which a vocabulary of ranks allows, that word's further positions wait until the lower rank
is done; so the ids are those of greedy merging word by word. The ids of a shard's chunks are written as files sorted by
hash, which tasks map to put texts together; a decoded text that differs from its text betrays chunks with equal hashes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.chunks import bytes_of, column_slices, cut, distinct, gathered, per_row
from histoframe.llm.hashing import row_hashes
from histoframe.llm.token_files import mapped
from histoframe.scratch import Scratch, exists, write_file

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SHIFT = 32
SEEN = 2_000_000  # hashes that a task remembers to emit a chunk once
BLOCK_BYTES = 1_000_000  # of chunks that one replay holds
OPEN = 256  # shards that a worker has mapped
ROWS = 50_000


class MergeReplay:
    """Ids of words by the ranks of a vocabulary file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.vocabulary = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        none = np.iinfo(np.int64).max
        self.byte_pairs = np.full((256, 256), none, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.pairs.get(int(self.byte_ids[a]) << SHIFT | int(self.byte_ids[b]), none)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n = len(raw)
        if not n:
            return [[] for _ in words]
        word_of = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(word_of[:-1] == word_of[1:])
        ranks = self.byte_pairs[raw[inside], raw[inside + 1]]
        hit = ranks < np.iinfo(np.int64).max
        inside, ranks = inside[hit], ranks[hit]
        order = np.argsort(ranks, kind="stable")
        inside, ranks = inside[order], ranks[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        # The index by rank: positions of the left token of each pair that joins to it.
        index = {int(ranks[a]): inside[a:b].tolist() for a, b in zip(heads, np.append(heads, len(ranks))[1:], strict=True)}
        ids, ahead, behind = self.byte_ids[raw].tolist(), np.arange(1, n + 1), np.arange(-1, n - 1)
        ahead[ends[lengths > 0] - 1] = -1
        behind[starts[lengths > 0]] = -1
        ahead, behind, word_of = ahead.tolist(), behind.tolist(), word_of.tolist()
        pairs, heap = self.pairs, list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = sorted(index.pop(rank))
            held = -1
            for i in places:
                if word_of[i] == held:
                    index[rank].append(i)
                    continue
                j, left = ahead[i], ids[i]
                if left < 0 or j < 0 or pairs.get(left << SHIFT | ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                k, h = ahead[j], behind[i]
                ahead[i] = k
                lowest = rank
                if k >= 0:
                    behind[k] = i
                    new = pairs.get(rank << SHIFT | ids[k])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(heap, new)
                        lowest = min(lowest, new)
                if h >= 0:
                    new = pairs.get(ids[h] << SHIFT | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(heap, new)
                        lowest = min(lowest, new)
                if lowest < rank:
                    held = word_of[i]
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
        final = np.array(ids, np.int64)
        alive = final >= 0
        cuts = np.concatenate([[0], np.cumsum(alive)])
        kept = final[alive].tolist()
        return [kept[a:b] for a, b in zip(cuts[starts].tolist(), cuts[ends].tolist(), strict=True)]

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks of text, as little-endian unsigned 32-bit integers: each distinct word of all is replayed once."""
        split = [self.pattern.findall(c.decode("utf-8", "replace")) for c in chunks]
        words = list({w for found in split for w in found})
        ids = dict(zip(words, (np.array(x, "<u4").tobytes() for x in self.replay([w.encode() for w in words])), strict=True))
        return [b"".join([ids[w] for w in found]) for found in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is empty."""
        return self.encode_chunks([(t or "").encode("utf-8", "replace") for t in texts])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids that `encode` returned."""
        raw, _ = gathered(*self.vocabulary, np.frombuffer(ids, "<u4").astype(np.int64))
        return raw.tobytes()


@functools.lru_cache(maxsize=2)
def replayer(rank_file: str, pattern: str) -> MergeReplay:
    """One a worker process and vocabulary."""
    return MergeReplay(rank_file, pattern)


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, chunk): the chunks of a task's texts, each once, but for those met again after SEEN others."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for _, some in column_slices(batch.column(0)):
            raw, starts = bytes_of(some)
            chunks, _ = distinct(raw, cut(raw, starts))
            own = row_hashes(*bytes_of(chunks))
            place = np.minimum(np.searchsorted(seen, own), max(0, len(seen) - 1))
            new = np.flatnonzero(seen[place] != own) if len(seen) else np.arange(len(own))
            seen = np.sort(np.concatenate([seen if len(seen) < SEEN else seen[:0], own[new]]))
            rows = pa.RecordBatch.from_arrays([pa.array(own[new].view(np.int64)), chunks.take(pa.array(new))], ["hash", "chunk"])
            for lo in range(0, rows.num_rows, ROWS):
                yield rows.slice(lo, ROWS)


def write_chunk_ids(docs: DataFrame, folder: str, rank_file: str, pattern: str, shards: int) -> None:
    """Files of the ids of all distinct chunks of the corpus, by shards of their hashes; each chunk is replayed once.

    A shard is `.hash` (sorted, 64-bit), `.starts` (64-bit, one more) and `.ids` (32-bit). Of chunks with one hash the first
    is kept; readers tell them apart by their decoded bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        bpe, shard = replayer(rank_file, pattern), first.column(0)[0].as_py()
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def ids(out) -> None:
            block, held, last = [], 0, None

            def flush() -> None:
                found = bpe.encode_chunks(block)
                sizes.append(np.fromiter((len(x) // 4 for x in found), np.int64, len(found)))
                out.write(b"".join(found))

            for batch in itertools.chain([first], batches):
                if not batch.num_rows:
                    continue
                own = batch.column(1).to_numpy()
                new = np.append(last is None or own[0] != last, own[1:] != own[:-1])
                last = own[-1]
                hashes.append(own[new])
                chunks = batch.column(2).filter(pa.array(new)).to_pylist()
                block += chunks
                held += sum(map(len, chunks))
                if held >= BLOCK_BYTES:
                    flush()
                    block, held = [], 0
            flush()

        stem = f"{folder}/chunks-{shard:05d}"
        write_file(f"{stem}.ids", ids)
        write_file(f"{stem}.starts", lambda out: out.write(np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype("<i8").tobytes()))
        write_file(f"{stem}.hash", lambda out: out.write(np.concatenate(hashes).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    rows = docs.select("text").mapInArrow(_distinct_chunks, "hash long, chunk binary")
    dealt = rows.select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), "hash", "chunk").repartitionById(shards, "shard").sortWithinPartitions("hash", "chunk")
    dealt.mapInArrow(write, "shard int").agg(F.count("*")).collect()


class ChunkIds:
    """The files of `write_chunk_ids`; a shard is mapped when a chunk of it is asked for, OPEN at most at once."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.shard = functools.lru_cache(maxsize=OPEN)(self._shard)

    def _shard(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stem = f"{self.folder}/chunks-{number:05d}"
        if not exists(f"{stem}.hash"):
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        return tuple(mapped(f"{stem}.{kind}", np.dtype(dtype)) for kind, dtype in (("hash", "<i8"), ("starts", "<i8"), ("ids", "<u4")))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks with these hashes, one chunk after another, and where each starts; unknown ones have none."""
        signed = hashes.view(np.int64)
        shard = np.mod(signed, self.shards)
        order = np.lexsort((signed, shard))
        lengths = np.zeros(len(hashes), np.int64)
        parts: list[np.ndarray] = []
        heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            keys, starts, ids = self.shard(int(shard[order[a]]))
            asked = signed[order[a:b]]
            place = np.searchsorted(keys, asked)
            known = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == asked) if len(keys) else place[:0]
            place = place[known]
            first, sizes = starts[place], starts[place + 1] - starts[place]
            lengths[a:b][known] = sizes
            shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            parts.append(ids[np.arange(len(shift)) + shift])
        flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        ends = np.cumsum(lengths)
        back, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        back[order], sizes[order] = ends - lengths, lengths
        starts = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(back - starts[:-1], sizes)
        return flat[np.arange(len(shift)) + shift], starts


@functools.lru_cache(maxsize=2)
def _chunk_ids(folder: str, shards: int) -> ChunkIds:
    return ChunkIds(folder, shards)


def checked(bpe: MergeReplay, raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, if they decode to the bytes of their texts; texts for which they don't are replayed by themselves."""
    decoded, lengths = gathered(*bpe.vocabulary, ids.astype(np.int64))
    if len(decoded) == len(raw) and (decoded == raw).all() and (per_row(lengths, np.concatenate([[0], np.cumsum(counts)])) == np.diff(starts)).all():
        return ids, counts
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for k, part in enumerate(parts):
        text = raw[starts[k] : starts[k + 1]].tobytes()
        if bpe.decode(part.tobytes()) != text:
            parts[k] = np.frombuffer(bpe.encode_chunks([text])[0], "<u4")
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, shards: int | None = None) -> DataFrame:
    """Encode every whole text (null: empty) and decode its ids; one row a document with digests of both.

    The distinct chunks of the whole corpus are encoded first, by merge replay, and written as files; texts are then put
    together from these. Repeated rows and null ids are kept; an empty text has no ids and the digests of no bytes.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = Scratch(spark, "merge-replay").folder("chunks")
    write_chunk_ids(docs, folder, rank_file, pattern, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = replayer(rank_file, pattern), _chunk_ids(folder, shards)
        for batch in batches:
            for at, some in column_slices(batch.column(1)):
                raw, starts = bytes_of(some)
                bounds = cut(raw, starts)
                chunks, index = distinct(raw, bounds)
                ids, lengths = gathered(*known.find(row_hashes(*bytes_of(chunks))), index)
                ids, counts = checked(bpe, raw, starts, ids, per_row(lengths, np.searchsorted(bounds, starts)))
                decoded, sizes = gathered(*bpe.vocabulary, ids.astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(counts)])
                cuts = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
                ids, decoded, ends = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes()), (ends * 4).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(at, len(some)),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_sha256": [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
                        "decoded_sha256": [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    }
                )

    return docs.mapInArrow(run, SCHEMA)
