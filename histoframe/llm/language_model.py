"""An n-gram language model of order two in compact memory-mapped tries, counted on the whole training corpus.

Level one is the vocabulary: word hashes in ascending order with their counts, in shards by ranges of the hash. A word's
id is its place over all shards. Level two is a trie of bigrams in shards: the contexts that occur in a shard (Elias-Fano),
a pointer from each to its successors (Elias-Fano), and the successors' word ids, which are ascending after a context
and made monotone over the shard by adding the last value of the context before (Elias-Fano). A bigram is looked up by
finding its context, taking the value before its successors as the base and searching base + word; each successor has an
eight-bit code of its discounted log10 probability, each context one of the weight that goes to the unigrams:

    p(w | v) = (c(v w) - D) / c(v) + D n(v) / c(v) * (c(w) + 1) / (N + V + 1)

with D = `DISCOUNT` and n(v) the distinct successors of v; an unseen context gives the unigrams alone. The end of a text is
a word, and the context of the first word. The shard of a bigram is a hash of its context; contexts with more than
`hot_context` tokens are split by the word too, and their n(v), a few for each shard, go into the manifest. Nothing that
grows with the vocabulary passes through the driver.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoframe.llm.elias_fano import EliasFano
from histoframe.llm.encoder import slices
from histoframe.llm.hashing import mix, word_hashes
from histoframe.llm.token_files import mapped
from histoframe.scratch import Scratch, open_fs, write_file

DISCOUNT = 0.8
CODE_RANGE = 8.0  # log10 probabilities are coded in steps of CODE_RANGE / 255 from 0 downwards
BUFFER = 1_000_000
SHARD_TOKENS = 1_500_000
SLICE = 1_000_000
END = np.uint64(0x6E1F_0A55_93C4_27D1 >> 1)
HALF = np.uint64(1)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_rows(folds: int = 7, fold: int = 2) -> Column:
    """Rows that aren't trained on: crc32 of doc_id as text, modulo `folds`. Rows without an id are trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of all texts with an end after each text, and where each text starts."""
    hashes, starts = word_hashes(texts)
    n = len(texts)
    out = np.full(len(hashes) + n, END, np.uint64)
    text_of = np.repeat(np.arange(n), np.diff(starts))
    out[np.arange(len(hashes)) + text_of] = hashes >> HALF
    return out, starts + np.arange(n + 1)


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * 255 / CODE_RANGE), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-np.arange(256) * CODE_RANGE / 255)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, and their summed counts."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _shard_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, distinct keys, counts) from rows (shard, key, count) that are sorted by shard and key."""
    current, keys, counts = None, [], []
    for batch in batches:
        shard, key, count = (batch.column(k).to_numpy() for k in range(3))
        if not len(shard):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if current is not None and shard[a] != current:
                yield current, *_summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
            current = int(shard[a])
            k, c = _summed(key[a:b], count[a:b])
            keys.append(k)
            counts.append(c)
    if current is not None:
        yield current, *_summed(np.concatenate(keys), np.concatenate(counts))


def _vocabulary_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) >> np.uint64(31)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _bigram_shard(context: np.ndarray, word: np.ndarray, counts: np.ndarray, hot: int, shards: int) -> np.ndarray:
    """The shard of each bigram; contexts with more than `hot` tokens are split by the word."""
    parts = counts // hot + 1
    part = np.where(parts > 1, word % parts, 0)
    return (mix((context * 64 + part).astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


class Vocabulary:
    """Level one: sorted hashes and counts in memory-mapped shards."""

    def __init__(self, folder: str, shards: int, sizes: dict[int, int]):
        self.shards = shards
        self.hashes, self.counts, self.bases, base = {}, {}, {}, 0
        for shard in sorted(sizes):
            self.hashes[shard] = mapped(f"{folder}/words-{shard:05d}.hash", np.dtype("<i8"))
            self.counts[shard] = mapped(f"{folder}/words-{shard:05d}.count", np.dtype("<i8"))
            self.bases[shard] = base
            base += sizes[shard]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of distinct hashes in ascending order."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = _vocabulary_shard(hashes, self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s, own in self.hashes.items():
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                want = hashes[a:b].astype(np.int64)
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hit = own[place] == want
                ids[a:b] = np.where(hit, place + self.bases[s], -1)
                counts[a:b] = np.where(hit, self.counts[s][place], 0)
        return ids, counts


class Bigrams:
    """Level two: one shard's trie."""

    def __init__(self, folder: str, shard: int):
        words = mapped(f"{folder}/bigrams-{shard:05d}.trie", np.dtype("<u8"))
        self.contexts, at = EliasFano.mapped(words, 0)
        self.pointers, at = EliasFano.mapped(words, at)
        self.successors, at = EliasFano.mapped(words, at)
        codes = words[at:].view(np.uint8)
        self.weights, self.probabilities = codes[: self.contexts.n], codes[self.contexts.n :]

    @staticmethod
    def file_parts(keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, context_of: np.ndarray, contexts: np.ndarray) -> list[np.ndarray]:
        """The arrays of a trie file for sorted keys (context << 32 | word)."""
        heads = np.flatnonzero(np.diff(context_of, prepend=-1))
        words = (keys & 0xFFFFFFFF).astype(np.uint64)
        lasts = words[np.append(heads[1:], len(keys)) - 1] if len(keys) else words
        bases = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lasts + np.uint64(1))])[: len(heads)]
        monotone = words + bases[context_of]
        weights = _code(np.log10(np.minimum(1.0, DISCOUNT * np.bincount(context_of, minlength=len(contexts)) / np.maximum(context_counts, 1))))
        shares = _code(np.log10((counts - DISCOUNT) / context_counts[context_of]))
        parts: list[np.ndarray] = []
        for values in (contexts, heads, monotone):
            parts += EliasFano.build(values).arrays()
        return [*parts, weights, shares]

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability (0: unseen) and the context's weight for unigrams (1: unseen context)."""
        share, weight = np.zeros(len(context)), np.ones(len(context))
        place = self.contexts.find(context)
        seen = np.flatnonzero(place >= 0)
        if len(seen):
            place = place[seen]
            weight[seen] = _VALUE[self.weights[place]]
            start = self.pointers.access(place).astype(np.int64)
            before = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
            found = self.successors.find(before + word[seen].astype(np.uint64))
            after = np.where(place + 1 < self.contexts.n, self.pointers.access(np.minimum(place + 1, self.contexts.n - 1)).astype(np.int64), self.successors.n)
            hit = (found >= start) & (found < after)
            share[seen[hit]] = _VALUE[self.probabilities[found[hit]]]
        return share, weight


@functools.lru_cache(maxsize=1)
def load_vocabulary(folder: str) -> tuple[Vocabulary, dict]:
    """Level one and its manifest, once a worker process."""
    file_system, path = open_fs(f"{folder}/words.json")
    with file_system.open_input_file(path) as f:
        manifest = json.loads(f.read())
    return Vocabulary(folder, manifest["shards"], {int(k): v for k, v in manifest["sizes"].items()}), manifest


@functools.lru_cache(maxsize=1)
def load_model(folder: str) -> tuple[Vocabulary, dict[int, Bigrams], dict]:
    """Both levels and the manifest, once a worker process."""
    file_system, path = open_fs(f"{folder}/model.json")
    with file_system.open_input_file(path) as f:
        manifest = json.loads(f.read())
    vocabulary, _ = load_vocabulary(folder)
    return vocabulary, {s: Bigrams(folder, s) for s in manifest["tries"]}, manifest


def _counted(columns: int, batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts for each buffer of `BUFFER` tokens, over all texts of a task."""
    held, size = [], 0
    for batch in batches:
        for some in slices(batch.column(columns).to_pylist(), SLICE):
            held.append(keys_of(some))
            size += len(held[-1])
            if size >= BUFFER:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _rows(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 100_000):
        cut = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(keys[cut].astype(np.int64)), pa.array(counts[cut].astype(np.int64))], ["shard", "key", "n"])


def train_model(docs: DataFrame, shards: int | None = None) -> str:
    """Count and write the model of all texts (null: empty) into the shared folder; returns that folder."""
    spark = docs.sparkSession
    folder = Scratch(spark, "language-model").folder("model")
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _counted(0, batches, lambda some: _tokens(some)[0]):
            yield from _rows(_vocabulary_shard(keys, parts), keys, counts)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _shard_stream(batches):
            write_file(f"{folder}/words-{shard:05d}.hash", lambda out, x=keys: out.write(x.astype("<i8").tobytes()))
            write_file(f"{folder}/words-{shard:05d}.count", lambda out, x=counts: out.write(x.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    keyed = "shard int, key long, n long"
    dealt = texts.mapInArrow(words, keyed).repartition(parts, "shard").sortWithinPartitions("shard", "key")
    sizes = dealt.mapInArrow(write_words, "shard int, words long, tokens long").collect()  # one row a shard
    tokens, distinct = sum(r.tokens for r in sizes), sum(r.words for r in sizes)
    tries = max(parts, -(-tokens // SHARD_TOKENS))
    hot = max(100_000, tokens // (4 * tries))
    write_file(f"{folder}/words.json", lambda out: out.write(json.dumps({"shards": parts, "sizes": {r.shard: r.words for r in sizes}}).encode()))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = load_vocabulary(folder)

        def keys_of(some: list[str | None]) -> np.ndarray:
            hashes, _ = _tokens(some)
            known, inverse = np.unique(np.concatenate([[END], hashes]), return_inverse=True)
            ids = vocabulary.look_up(known)[0][inverse].ravel()
            return ids[:-1] << 32 | ids[1:]

        for keys, counts in _counted(0, batches, keys_of):
            context, word = keys >> 32, keys & 0xFFFFFFFF
            heads = np.flatnonzero(np.diff(context, prepend=-1))
            totals = np.repeat(_counts_of(vocabulary, context[heads]), np.diff(np.append(heads, len(keys))))
            yield from _rows(_bigram_shard(context, word, totals, hot, tries), keys, counts)

    def write_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = load_vocabulary(folder)
        for shard, keys, counts in _shard_stream(batches):
            contexts, context_of = np.unique(keys >> 32, return_inverse=True)
            totals = _counts_of(vocabulary, contexts)
            arrays = Bigrams.file_parts(keys, counts, totals, context_of, contexts)
            raw = b"".join(x.tobytes() for x in arrays)
            write_file(f"{folder}/bigrams-{shard:05d}.trie", lambda out, x=raw: out.write(x + bytes(-len(x) % 8)))
            hot_ones = np.flatnonzero(totals >= hot)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "hot": pa.array([contexts[hot_ones].tolist()], pa.list_(pa.int64())), "successors": pa.array([np.bincount(context_of)[hot_ones].tolist()], pa.list_(pa.int64())), "counts": pa.array([totals[hot_ones].tolist()], pa.list_(pa.int64()))}
            )

    dealt = texts.mapInArrow(bigrams, keyed).repartition(tries, "shard").sortWithinPartitions("shard", "key")
    rows = dealt.mapInArrow(write_tries, "shard int, hot array<long>, successors array<long>, counts array<long>").collect()  # one row a shard
    successors: dict[int, int] = {}
    totals: dict[int, int] = {}
    for r in rows:
        for context, n, count in zip(r.hot, r.successors, r.counts, strict=True):
            successors[context] = successors.get(context, 0) + n
            totals[context] = count
    weights = {context: min(1.0, DISCOUNT * n / totals[context]) for context, n in successors.items()}
    model = {"tries": [r.shard for r in rows], "n_tries": tries, "hot": hot, "tokens": tokens, "distinct": distinct, "weights": weights}
    write_file(f"{folder}/model.json", lambda out: out.write(json.dumps(model).encode()))
    return folder


def _counts_of(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Counts of word ids in ascending order."""
    out = np.zeros(len(ids), np.int64)
    for shard, base in vocabulary.bases.items():
        own = vocabulary.counts[shard]
        a, b = np.searchsorted(ids, (base, base + len(own)))
        if a < b:
            out[a:b] = own[ids[a:b] - base]
    return out


def score_texts(texts: list[str | None], model: tuple[Vocabulary, dict[int, Bigrams], dict]) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and model score of each text."""
    vocabulary, tries, manifest = model
    hashes, starts = _tokens(texts)
    known, inverse = np.unique(np.concatenate([[END], hashes]), return_inverse=True)
    ids, counts = vocabulary.look_up(known)
    inverse = inverse.ravel()
    ids, counts = ids[inverse], counts[inverse]
    unigram = (counts[1:] + 1) / (manifest["tokens"] + manifest["distinct"] + 1)
    share, weight = np.zeros(len(hashes)), np.ones(len(hashes))
    context, word = ids[:-1], ids[1:]
    ask = np.flatnonzero((context >= 0))
    # A word that isn't known has no successor entry; it is asked for by an id that no word has, for the weight.
    keys, back = np.unique(context[ask] << 32 | np.where(word[ask] >= 0, word[ask], 0xFFFFFFFF), return_inverse=True)
    if len(keys):
        c, w = keys >> 32, keys & 0xFFFFFFFF
        heads = np.flatnonzero(np.diff(c, prepend=-1))
        totals = np.repeat(_counts_of(vocabulary, c[heads]), np.diff(np.append(heads, len(keys))))
        shard = _bigram_shard(c, w, totals, manifest["hot"], manifest["n_tries"])
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(manifest["n_tries"] + 1))
        s, g = np.zeros(len(keys)), np.ones(len(keys))
        for k, trie in tries.items():
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                s[own], g[own] = trie.look_up(c[own], w[own])
        hot = np.flatnonzero(totals >= manifest["hot"])
        if len(hot):
            g[hot] = [manifest["weights"].get(str(x), 1.0) for x in c[hot].tolist()]
        share[ask], weight[ask] = s[back.ravel()], g[back.ravel()]
    logs = np.log10(share + weight * unigram)
    base = np.log10(unigram)
    cut = starts[:-1]
    return np.diff(starts), np.add.reduceat((counts[1:] > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(logs, cut)


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Train on the rows outside the fold and score every whole text; one row a document, repeated rows included.

    A null text is empty: its only token is the end. Where nothing is trained on, every token has base probability one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out_rows(folds, fold).alias("held_out"))
    folder = train_model(docs.where(~F.col("held_out")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(folder)
        for batch in batches:
            at = 0
            for some in slices(batch.column(1).to_pylist(), 2 * SLICE):
                n_tokens, n_known, base, score = score_texts(some, model)
                part = batch.slice(at, len(some))
                columns = [part.column(0), part.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(some), model[2]["tokens"], np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])
                at += len(some)

    return docs.mapInArrow(run, SCHEMA)
