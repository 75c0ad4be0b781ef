"""Token files, merge replay and packing against the libraries themselves."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histoframe.llm import merges
from histoframe.llm.merges import MergeReplay, bpe_round_trip
from histoframe.llm.encoder import ChunkEncoder
from histoframe.llm.packing import TIERS, pack_documents, pack_lengths, step_groups
from histoframe.llm.token_files import read_token_files, shard_bases, token_files, write_token_files
from histoframe.scratch import Scratch

from .conftest import TEXTS, crc, sha

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library_ids(text):
    t = Tokenizer.from_file(BYTE_BPE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_files_hold_all_ids_in_order(docs):
    got = {r.doc_id: r for r in token_files(docs, BYTE_BPE, 4).collect()}
    start = 0
    for doc_id, text in sorted(TEXTS):
        ids = library_ids(text)
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(TEXTS)


def test_ids_are_the_library_defaults_with_added_tokens(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "two  <|endoftext|><|endoftext|>\n c", "x<|endoftext|> b a <|endoftext|", "a b <|endoftext|> b a", "b a <|endoftext |> b", None]
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    start = 0
    for r in sorted(token_files(rows, BYTE_BPE, 2).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        start += r.n_tokens
    for r in pack_documents(rows, BYTE_BPE).collect():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])


def test_token_files_format_and_edges(spark, docs, nothing):
    folder = Scratch(spark, "t").folder("f")
    manifest = write_token_files(docs, folder, BYTE_BPE, 3)
    bases = {r.shard: r.base for r in shard_bases(spark, manifest).collect()}
    for m in manifest:
        stem = f"{folder}/part-{m.shard:05d}".removeprefix("file:")
        ids, offsets, own = np.fromfile(f"{stem}.ids", "<u2"), np.fromfile(f"{stem}.offsets", "<i8"), np.fromfile(f"{stem}.docs", "<i8")
        assert len(ids) == m.n_ids == offsets[-1] and len(own) == m.n_docs == len(offsets) - 1 and (np.diff(own) > 0).all()
    assert sorted(bases.values())[0] == 0
    assert token_files(nothing, BYTE_BPE, 2).count() == 0
    twice = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("doc_id")))
    assert token_files(twice, BYTE_BPE, 3).count() == 2 * (len(TEXTS) - 1)
    assert read_token_files(spark, folder, manifest, rows=2).count() == len(TEXTS)


def test_merge_replay_is_tiktoken(docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for doc_id, text in TEXTS:
        ids = t.encode_ordinary(text or "")
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode()))
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want
    assert bpe_round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    replay, rng = MergeReplay(RANKS, public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(rng.choice("abcdet  \n.,ñ0123'") for _ in range(rng.randint(0, 200))) for _ in range(600)] + ["ab" * 400, "a" * 999]
    for text, raw in zip(texts, replay.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode_ordinary(text)
        assert replay.decode(raw) == text.encode()


def test_merge_replay_over_shards_and_colliding_hashes(spark, docs, monkeypatch):
    want = {r.doc_id: r for r in bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for shards, seen in ((1, 10), (7, 10**6)):
        monkeypatch.setattr(merges, "SEEN", seen)
        got = {r.doc_id: r for r in bpe_round_trip(docs.repartition(5), RANKS, public_tokenizers.PATTERN, shards).collect()}
        assert got == want
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, " "), (3, "\n" * 5000), (4, "ab" * 30000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in bpe_round_trip(rows, RANKS, public_tokenizers.PATTERN).collect()) == [0, 1, 1, 2, 3, 4]
    assert all(r.decoded_sha256 == sha({2: " ", 3: "\n" * 5000, 4: "ab" * 30000}.get(r.doc_id, "a b").encode()) for r in bpe_round_trip(rows, RANKS, public_tokenizers.PATTERN).collect())
    # Chunks that share a hash with another one are found by their decoded bytes and replayed apart.
    replay = MergeReplay(RANKS, public_tokenizers.PATTERN)
    raw = np.frombuffer(b"one two three", np.uint8)
    wrong = [np.frombuffer(x, "<u4") for x in replay.encode_chunks([b"one", b" two", b" tree"])]
    ids, counts = merges.checked(replay, raw, np.array([0, 13]), np.concatenate(wrong), np.array([sum(map(len, wrong))]))
    assert ids.tobytes() == replay.encode(["one two three"])[0] and counts.tolist() == [len(ids)]


def test_ranks_below_the_one_at_hand_come_first():
    replay = MergeReplay.__new__(MergeReplay)
    tokens = [bytes([b]) for b in range(256)] + [b"xyx", b"xy", b"yx"]
    replay.ranks = {t: k for k, t in enumerate(tokens)}
    replay.pairs = {}
    for token, rank in replay.ranks.items():
        for cut in range(1, len(token)):
            if token[:cut] in replay.ranks and token[cut:] in replay.ranks:
                replay.pairs[replay.ranks[token[:cut]] << 32 | replay.ranks[token[cut:]]] = rank
    replay.byte_ids = np.arange(256)
    replay.byte_pairs = np.full((256, 256), np.iinfo(np.int64).max)
    for a in b"xy":
        for b in b"xy":
            replay.byte_pairs[a, b] = replay.pairs.get(a << 32 | b, np.iinfo(np.int64).max)

    def greedy(word):
        ids = list(word)
        while True:
            found = [(replay.pairs[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in replay.pairs]
            if not found:
                return ids
            rank, k = min(found)
            ids[k : k + 2] = [rank]

    rng = random.Random(1)
    words = [bytes(rng.choice(b"xy") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    assert replay.replay(words) == [greedy(w) for w in words]


def test_packing_places_every_token_once(docs, nothing):
    rows = pack_documents(docs, BYTE_BPE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in TEXTS:
        ids, at = library_ids(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert pack_documents(nothing, BYTE_BPE).count() == 0


def test_step_groups_are_balanced():
    rng = random.Random(8)
    lengths = [rng.choice([1, 3, 129, 700, 1025, rng.randint(1, 6000)]) for _ in range(1500)]
    sizes = [sum(p[2] for p in pieces) for _, pieces in pack_lengths(lengths)]
    groups, made = step_groups(sizes, TIERS, 16 * 1024)
    filled, tier_of = [0] * made, {}
    for n, (tier, group) in zip(sizes, groups, strict=True):
        filled[group] += n
        assert n <= tier and tier_of.setdefault(group, tier) == tier
    for tier in TIERS:
        own = [filled[g] for g in range(made) if tier_of[g] == tier]
        assert not own or max(own) <= 16 * 1024 + tier and max(own) - min(own) <= tier
    assert step_groups([], TIERS, 9) == ([], 0)


def test_chunks_of_odd_texts_are_the_librarys():
    rng = random.Random(6)
    library = Tokenizer.from_file(BYTE_BPE)
    signs = ["a", "b", "Z", "é", "東", "、", "\u3000", "\u00a0", "\u2003", "\u2014", "\u0085", "\x1c", " ", " ", "\n", "\t", ".", "'", "'s", "0", "<|endoftext|>", "\u200b", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "\n", "x" * 5000, "東京" * 3000]
    small = ChunkEncoder(BYTE_BPE, keep=20_000)
    for lo in range(0, len(texts), 20):
        some = texts[lo : lo + 20]
        for text, ids in zip(some, small.encode(some), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert small.kept < 20_000 + 20 * 30 * 300


def test_packing_lengths():
    rng = random.Random(3)
    for n in (0, 1, 7, 500):
        lengths = [rng.choice([1, 2, 129, 1024, 1025, rng.randint(1, 6000)]) for _ in range(n)]
        seen = {}
        for tier, pieces in pack_lengths(lengths):
            assert sum(p[2] for p in pieces) == tier
            for doc, start, length in pieces:
                seen.setdefault(doc, []).append((start, length))
        for doc, want in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[doc]):
                assert start == at
                at += length
            assert at == want
