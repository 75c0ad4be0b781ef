"""Texts of an Arrow column cut into chunks, each slice's distinct chunks once.

The split patterns of byte-level vocabularies start a new match at a single space between two characters that aren't white
space, on both sides of a single line break between two such characters, and where a mark follows a letter. So whatever
is done to the matches of a text can be done to its chunks, one after another. What stands beside other white space isn't
cut: fewer cuts are always right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000
#: First two UTF-8 bytes of white space beyond ASCII, which may follow a space; and its lead bytes.
WIDE_SPACE = np.array([0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380], np.uint16)
WIDE_LEADS = np.array([0xE1, 0xE2, 0xE3], np.uint8)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls empty, and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def binary_column(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The other way round: rows raw[starts[k]:starts[k + 1]] as a binary column, without a copy."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, "<i4")), pa.py_buffer(np.ascontiguousarray(raw))])


def column_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part of the column) of about so many bytes each; every text stays whole."""
    _, starts = bytes_of(column)
    at, n = 0, len(starts) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def cut(raw: np.ndarray, starts: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where the chunks of joined texts start; those marked `whole` are one chunk."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = raw[at - 1], raw[at + 1]
    good = (before > 32) & (after > 32)
    at, before, after = at[good], before[good], after[good]
    odd = np.zeros(len(at), bool)
    ahead = np.flatnonzero(after >= 0xC2)
    second = raw[np.minimum(at[ahead] + 2, len(raw) - 1)]
    odd[ahead] = np.isin(after[ahead].astype(np.uint16) << 8 | second, WIDE_SPACE)
    behind = np.flatnonzero(before >= 0x80)
    place = at[behind]
    odd[behind] |= (raw[np.maximum(place - 2, 0)] == 0xC2) | np.isin(raw[np.maximum(place - 3, 0)], WIDE_LEADS)
    at = at[~odd]
    marks = np.flatnonzero(MARK[raw])
    marks = marks[(marks > 0) & LETTER[raw[marks - 1]]]
    cuts = np.concatenate([at, at[raw[at] == 10] + 1, marks])
    if whole is not None and whole.any():
        cuts = cuts[~whole[np.searchsorted(starts, cuts, "right") - 1]]
    edge[cuts] = True
    edge[len(raw)] = False
    return np.flatnonzero(edge)


def distinct(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct chunks, and for each chunk the number of its distinct one."""
    coded = binary_column(raw, np.append(bounds, len(raw))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def gathered(flat: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[i]:starts[i + 1]] for each i of the index, one after another; and their lengths."""
    lengths = np.diff(starts)[index]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts[index] - (ends - lengths), lengths)
    return flat[np.arange(len(shift)) + shift], lengths


def per_row(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of lengths[firsts[k]:firsts[k + 1]]."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return sums[firsts[1:]] - sums[firsts[:-1]]
