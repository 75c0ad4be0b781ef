"""Byte-level BPE ids by the tokenizers library, each distinct space-led chunk encoded once per worker."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from histoframe.llm.chunks import bytes_of, column_slices, cut, distinct, gathered, per_row

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

JOIN_CHARS = 200_000
SLICE_CHARS = 2_000_000
KEEP_BYTES = 256_000_000
LONG_CHUNK = 256
ENTRY = 200  # bytes that Python needs for a chunk in the store beside its own


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Consecutive parts of a list, each of about so many characters; every text stays whole."""
    some: list[str | None] = []
    held = 0
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some


class ChunkEncoder:
    """Encodes texts as the library does, chunk by chunk.

    A chunk's ids are kept by chunk; after `keep` bytes the store starts anew, and chunks of over LONG_CHUNK bytes aren't
    kept, which bounds memory for texts without spaces too. Texts that hold an added token of the vocabulary are encoded
    whole, as the library matches these before it makes pieces.
    """

    def __init__(self, path: str, keep: int = KEEP_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.keep, self.kept = keep, 0
        self.known: dict[bytes, bytes] = {}
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[-1]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes], added: bool) -> dict[bytes, bytes]:
        """Ids of chunks: plain ones many at a time, as lines of one text, whose ids are parted at the line breaks.

        Plain are chunks without a line break or an added token that begin and end in something else than white space, but
        for one leading space: a line break beside them is a piece of its own and changes none of theirs.
        """
        found, odd, keys, plain = {}, [], [], []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if "\n" in text or text[-1].isspace() or (text[0].isspace() and (text[0] != " " or text[1].isspace())) or (added and any(t in text for t in self.added)):
                odd.append((chunk, text))
            else:
                keys.append(chunk)
                plain.append(text)
        at, width = 0, self.dtype.itemsize
        while at < len(plain):
            first, chars = at, 0
            while at < len(plain) and chars < JOIN_CHARS:
                chars += len(plain[at]) + 1
                at += 1
            (joined,) = self.tokenizer.encode_batch_fast(["\n".join(plain[first:at])], add_special_tokens=False)
            ids = np.asarray(joined.ids, self.dtype)
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != at - first - 1:
                odd += zip(keys[first:at], plain[first:at], strict=True)
                continue
            raw, breaks = ids.tobytes(), (breaks * width).tolist()
            found.update(zip(keys[first:at], [raw[a:b] for a, b in zip([0, *(b + width for b in breaks)], [*breaks, len(raw)], strict=True)], strict=True))
        found.update(zip([c for c, _ in odd], self._whole([t for _, t in odd]), strict=True))
        return found

    def _ids_of(self, chunks: list[bytes], added: bool) -> list[bytes]:
        if self.kept > self.keep:
            self.known.clear()
            self.kept = 0
        ids = list(map(self.known.get, chunks))
        new = [k for k, x in enumerate(ids) if x is None]
        found = self._learn([chunks[k] for k in new], added)
        for k in new:
            chunk = chunks[k]
            ids[k] = found[chunk]
            if len(chunk) <= LONG_CHUNK:
                self.known[chunk] = ids[k]
                self.kept += len(chunk) + len(ids[k]) + ENTRY
        return ids

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids one text after another, ids of each text) for slices of a column of texts; nulls are empty.

        With `end_id` every text ends in it.
        """
        for at, some in column_slices(texts):
            raw, starts = bytes_of(some)
            whole = None
            for token in self.added:
                hit = pc.fill_null(pc.match_substring(some, token), False).to_numpy(zero_copy_only=False)
                whole = hit if whole is None else whole | hit
            bounds = cut(raw, starts, whole)
            chunks, index = distinct(raw, bounds)
            parts = self._ids_of(chunks.to_pylist(), whole is not None and bool(whole.any()))
            firsts = np.searchsorted(bounds, starts)
            if end_id is not None:
                parts.append(np.array([end_id], self.dtype).tobytes())
                index = np.insert(index, firsts[1:], len(parts) - 1)
                firsts = firsts + np.arange(len(firsts))
            ends = np.cumsum([0, *map(len, parts)]) // self.dtype.itemsize
            ids, lengths = gathered(np.frombuffer(b"".join(parts), self.dtype), ends, index)
            yield at, ids, per_row(lengths, firsts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        out: list[np.ndarray] = []
        for _, ids, counts in self.encode_column(pa.array(texts, pa.string())):
            out += np.split(ids, np.cumsum(counts)[:-1])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    return ChunkEncoder(path)
