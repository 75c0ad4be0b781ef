"""Exact removal of repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement.

Every window of `LENGTH` bytes has an anchor, the `GRAM` bytes in it with the least hash, leftmost among equals; equal
windows have equal anchors in the same place. Neighbouring windows with one anchor are a segment. Segments are brought
together by their anchor's hash, a row of a few numbers each and only the first of equal segments of a slice of text:
further equal segments, of one anchor and one 96-bit BLAKE2b digest of their bytes, repeat the first, whole. Of anchors with several different segments, the segments' bytes go on.

There, in blocks of whole anchor groups, each shard of a block sorts its suffixes and keeps its transform. The shards'
transforms are merged by interleave refinement: the order of all suffixes by their first h bytes is a sequence of shard
numbers; reading each shard's transform in that order, and dealing the shard numbers stably by what is read, gives the
order by more bytes. No suffix of one shard is ever compared with one of another. A transform is read in steps of q bytes
(5, or fewer where a block has over 2**16 different ones), so the order by `LENGTH` bytes takes LENGTH / q rounds. Where
round r shows a new boundary, the common prefix there is below q r bytes; what has none in the end are the repeated
intervals. In each, all windows but the earliest are repeats.

An anchor's segments are dealt to as many parts as hold `HOT` each. Where these are several, the earliest window of each
interval of a part meets its equals from the other parts by its bytes, in a grouping with map-side combining.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.encoder import slices
from histoframe.llm.hashing import joined, mix, prefix_sums, powers
from histoframe.llm.keys import free_name, with_row_keys
from histoframe.scratch import Scratch

LENGTH = 100
GRAM = 50
HOT = 1_024
BLOCK_BYTES = 150_000
STEPS = (5, 4, 2, 1)
SHARDS = 16
SLICE = 300_000
PIECE = 1 << 20  # windows handled at once; below 2**24
PLACE = np.uint64((1 << 24) - 1)
OCCURRENCE = "anchor long, segment long, check int, doc_id long, first int, last int, lead int"
JUDGED = "anchor long, doc_id long, first int, last int, lead int"


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, digest in two parts, text, first window, last window and anchor's lead of each segment of joined texts."""
    out: list[tuple[np.ndarray, ...]] = []
    sums = prefix_sums(raw)
    _, down = powers(len(raw))
    width = LENGTH - GRAM + 1
    ends = np.repeat(starts[1:] - 1, np.diff(starts))  # of the text at each byte
    for lo in range(0, max(0, len(raw) - LENGTH), PIECE):
        n = min(PIECE, len(raw) - LENGTH - lo)
        grams = n + width - 1
        anchors = mix((sums[lo + GRAM : lo + GRAM + grams] - sums[lo : lo + grams]) * down[lo : lo + grams])
        keys = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
        keys[:grams] = anchors & ~PLACE | np.arange(grams, dtype=np.uint64)
        rows = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & PLACE).astype(np.int64)
        valid = np.flatnonzero(ends[lo : lo + n] - np.arange(lo, lo + n) >= LENGTH)
        if not len(valid):
            continue
        place = place[valid]
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(valid, prepend=-9) != 1))
        first, last = valid[new], valid[np.append(new[1:], len(valid)) - 1]
        out.append((anchors[place[new]], first + lo, last + lo, place[new] - first))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int32, np.int64, np.int64, np.int64, np.int64))
    anchor, first, last, lead = (np.concatenate(x) for x in zip(*out, strict=True))
    view = memoryview(np.ascontiguousarray(raw))
    digests = b"".join([hashlib.blake2b(view[a:b], digest_size=12).digest() for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
    digest = np.frombuffer(digests, np.dtype([("segment", "<u8"), ("check", "<i4")]))
    text = np.searchsorted(starts, first, "right") - 1
    return anchor, digest["segment"].copy(), digest["check"].copy(), text, first - starts[text], last - starts[text], lead


def pieces_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bytes of the texts, long ones in pieces that share LENGTH - 1 bytes; and each piece's text and offset.

    Every window lies in one piece; what is held for a byte of text is held for some pieces at once only.
    """
    own: list[bytes] = []
    text_of: list[int] = []
    offsets: list[int] = []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            own.append(raw[at : at + PIECE + LENGTH - 1])
            text_of.append(k)
            offsets.append(at)
    return own, np.array(text_of), np.array(offsets)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of OCCURRENCE: the first of equal segments at hand; the others with lead -1 and keys that spread them."""
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]
    for batch in batches:
        at, ids = 0, batch.column(0).to_numpy()
        for some in slices(batch.column(1).to_pylist(), SLICE):
            own, text_of, offsets = pieces_of(some)
            docs = ids[at : at + len(some)][text_of]
            at += len(some)
            for lo in range(0, len(own), 4):  # pieces of long texts, or whole short ones
                hi = len(own) if len(own[lo]) < PIECE else lo + 4
                yield from _segment_rows(own[lo:hi], docs[lo:hi], offsets[lo:hi], names)
                if hi == len(own):
                    break


def _segment_rows(own: list[bytes], docs: np.ndarray, offsets: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    anchor, segment, check, piece, first, last, lead = segments(*joined(own))
    if not len(piece):
        return
    doc, first, last = docs[piece], first + offsets[piece], last + offsets[piece]
    order = np.lexsort((first, doc, check, segment, anchor))
    same = np.ones(len(order) - 1, bool)
    for x in (anchor, segment, check):
        same &= x[order[1:]] == x[order[:-1]]
    again = order[1:][same]
    lead[again] = -1
    segment[again] = check[again] = 0
    anchor[again] = mix(mix(doc[again].astype(np.uint64)) + first[again].astype(np.uint64))
    for lo in range(0, len(doc), 100_000):
        cut = slice(lo, lo + 100_000)
        columns = [anchor[cut].view(np.int64), segment[cut].view(np.int64), check[cut], doc[cut], *(x[cut].astype(np.int32) for x in (first, last, lead))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, segment, doc_id and place: repeats (lead -1, anchor 0) and candidates (the first of each
    segment of an anchor with several). Only the first segment of the anchor at hand is held."""
    names = [x.split()[0] for x in JUDGED.split(", ")]
    anchor_at = segment_at = check_at = None
    seen, held = 0, None  # segments of the anchor so far; its first one, while it is the only one
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, segment, check, lead = (batch.column(k).to_numpy() for k in (0, 1, 2, 6))
        passed = lead < 0
        new_anchor = np.append(anchor_at is None or anchor[0] != anchor_at, anchor[1:] != anchor[:-1]) | passed
        new_anchor[1:] |= passed[:-1]
        new_segment = new_anchor | np.append(segment_at is None or segment[0] != segment_at or check[0] != check_at, (segment[1:] != segment[:-1]) | (check[1:] != check[:-1]))
        repeat = passed | ~new_segment
        firsts = np.flatnonzero(~repeat)
        group = np.cumsum(new_anchor)[firsts] - new_anchor[0]  # the anchor that goes on is group 0, if any
        counts = np.bincount(group, minlength=1)
        goes_on = not new_anchor[0]
        before = np.zeros(len(counts), np.int64)
        if goes_on:
            before[0] = seen
        chosen = (counts + before)[group] > 1
        leads = lead.copy()
        leads[repeat] = -1
        rows = np.sort(np.concatenate([np.flatnonzero(repeat), firsts[chosen]]))
        judged = pa.RecordBatch.from_arrays([pa.array(np.where(repeat, 0, anchor)), *batch.columns[3:6], pa.array(leads)], names)
        out = judged.take(pa.array(rows))
        if goes_on and held is not None and counts[0]:
            yield held
            held = None
        elif not goes_on:
            held = None
        last_group = int(new_anchor.sum()) - int(new_anchor[0])
        in_last = firsts[group == last_group]
        seen = len(in_last) + (seen if goes_on and last_group == 0 else 0)
        if passed[-1]:
            seen, held = 0, None
        elif seen == 1 and len(in_last):
            held = judged.slice(int(in_last[0]), 1)
        elif last_group:
            held = None
        anchor_at, segment_at, check_at = anchor[-1], segment[-1], check[-1]
        if out.num_rows:
            yield out


def _steps(text: np.ndarray, after: np.ndarray) -> tuple[int, np.ndarray]:
    """The step q, and the rank of the q symbols from each place, as 16-bit numbers in their order."""
    for q in STEPS:
        key, at = np.zeros(len(text), np.uint64), np.arange(len(text))
        for _ in range(q):
            key = key * np.uint64(257) + text[at].astype(np.uint64)
            at = after[at]
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) <= 1 << 16:
            return q, rank.ravel().astype(np.uint16)
    raise AssertionError("single symbols always fit")


def merged_order(strings: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """String and offset of all suffixes in the order of their first LENGTH bytes, the common prefix of each with the one
    before it, and the step q: a prefix is known in whole steps, and LENGTH stands for that length or more.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    n = int(lengths.sum()) + len(strings)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(n, np.uint16)  # 0 ends a string, bytes are 1 to 256
    string_of = np.repeat(np.arange(len(strings)), lengths + 1)
    offset = np.arange(n) - starts[string_of]
    text[offset < lengths[string_of]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    after = np.arange(1, n + 1)
    after[starts + lengths] = starts
    q, symbols = _steps(text, after)

    # Each shard's suffix order by doubling; the shard leads the key, so that shards stay apart.
    shard = string_of % shards
    jump = after.copy()
    for _ in range(q - 1):
        jump = after[jump]
    _, rank = np.unique(shard * (1 << 16) + symbols, return_inverse=True)
    rank, reach = rank.ravel(), q
    while reach < 2 * int(lengths.max()) + 2 and int(rank.max()) < n - 1:
        _, rank = np.unique(rank * n + rank[jump], return_inverse=True)
        rank, jump, reach = rank.ravel(), jump[jump], 2 * reach
    order = np.argsort(rank, kind="stable")  # shard after shard

    # The transforms: for each place of a shard's order the q symbols before it, and where these stand in that order.
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = np.arange(n)
    before = np.empty(n, np.int64)
    before[after] = np.arange(n)
    for _ in range(q):
        back = before[back]
    transform = symbols[back[order]]
    leads_to = place[back[order]]

    # Interleave refinement: `turn` holds, for each place of the merged order, the place in its shard's order.
    turn, block, common = np.arange(n), np.zeros(n, np.int64), np.full(n, LENGTH)
    common[0] = 0
    for done in range(0, LENGTH, q):
        read = transform[turn]
        dealt = np.argsort(read, kind="stable")
        read, block = read[dealt], block[dealt]
        turn = leads_to[turn][dealt]
        edge = np.empty(n, bool)
        edge[0] = False
        edge[1:] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge)
        common[edge & (common == LENGTH)] = done
    suffix = order[turn]
    return string_of[suffix], offset[suffix], common, q


def repeated_intervals(strings: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of LENGTH bytes of the strings, in suffix order: string, offset, and the number of their interval.

    An interval goes on while the common prefix with the suffix before is LENGTH or more: windows are equal if, and only if,
    they have the same interval. Each string has at least LENGTH bytes.
    """
    string, offset, common, _ = merged_order(strings, shards)
    interval = np.cumsum(common < LENGTH)
    window = offset + LENGTH <= np.fromiter(map(len, strings), np.int64, len(strings))[string]
    return string[window], offset[window], interval[window]


def _segment_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each document with their bytes: from (doc_id, text, [anchor], [part], [first], [last])."""
    for batch in batches:
        for row in batch.to_pylist():
            raw = (row["text"] or "").encode("utf-8", "surrogatepass")
            n = len(row["anchors"])
            pieces = [raw[a : b + LENGTH] for a, b in zip(row["firsts"], row["lasts"], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"anchor": pa.array(row["anchors"], pa.int64()), "part": pa.array(row["parts"], pa.int32()), "hot": pa.array(row["hots"], pa.bool_()), "doc_id": pa.array([row["doc_id"]] * n, pa.int64()), "first": pa.array(row["firsts"], pa.int32()), "bytes": pa.array(pieces, pa.binary())}
            )


MATCH = "doc_id long, first int, last int, anchor long, window binary"


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of whole groups (anchor, part), in runs of windows; of anchors in several parts also the earliest windows."""
    names = [x.split()[0] for x in MATCH.split(", ")]

    def merge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        strings = rows["bytes"].to_pylist()
        doc, first, hot, anchor = (rows[c].to_numpy() for c in ("doc_id", "first", "hot", "anchor"))
        string, offset, interval = repeated_intervals(strings)
        d, start = doc[string], first[string] + offset
        order = np.lexsort((start, d, interval))
        string, offset, interval, d, start = (x[order] for x in (string, offset, interval, d, start))
        again = np.append(False, interval[1:] == interval[:-1])
        lone = ~again & hot[string]
        dd, ss = d[again], start[again]
        order = np.lexsort((ss, dd))
        dd, ss = dd[order], ss[order]
        new = np.flatnonzero((np.diff(dd, prepend=-1) != 0) | (np.diff(ss, prepend=-9) > 1)) if len(dd) else np.zeros(0, np.int64)
        if len(new):
            ends = np.append(new[1:], len(dd)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(dd[new]), pa.array(ss[new].astype(np.int32)), pa.array(ss[ends].astype(np.int32)), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary())], names)
        if lone.any():
            windows = [strings[k][a : a + LENGTH] for k, a in zip(string[lone].tolist(), offset[lone].tolist(), strict=True)]
            place = pa.array(start[lone].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(d[lone]), place, place, pa.array(anchor[string[lone]]), pa.array(windows, pa.binary())], names)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size + batch.nbytes > BLOCK_BYTES and held:
            # Whole groups go: those before the group that the held rows end with, and that one too if it ends there.
            rows = pa.Table.from_batches([*held, batch])
            anchor, part = rows["anchor"].to_numpy(), rows["part"].to_numpy()
            sizes = np.cumsum(np.fromiter(map(len, rows["bytes"].to_pylist()), np.int64, rows.num_rows))
            heads = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
            at, done = 0, 0
            for k in range(1, len(heads)):
                if sizes[heads[k] - 1] - done >= BLOCK_BYTES:
                    yield from merge(rows.slice(at, heads[k] - at).combine_chunks())
                    at, done = heads[k], sizes[heads[k] - 1]
            held = rows.slice(at).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from merge(pa.Table.from_batches(held).combine_chunks())


def _spans(raw: bytes, firsts: list[int] | None, lasts: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts or (), lasts or (), strict=True)):
        b = min(b + LENGTH, len(raw))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, first, last): runs of window starts that repeat an earlier window, from (doc_id, text) with unique ids."""
    occurrences = docs.mapInArrow(_occurrences, OCCURRENCE)
    dealt = occurrences.repartition("anchor").sortWithinPartitions("anchor", "segment", "check", "doc_id", "first")
    judged = scratch.table(dealt.mapInArrow(_judged, JUDGED), "judged")
    whole = judged.where("lead < 0").select("doc_id", "first", "last")
    candidates = judged.where("lead >= 0")
    hot = candidates.groupBy("anchor").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "first"), F.col("parts"))).cast("int")
    candidates = candidates.join(hot, "anchor", "left").withColumn("part", part).withColumn("hot", F.col("parts").isNotNull())
    row = F.struct("anchor", "part", "hot", "first", "last")
    by_doc = candidates.groupBy("doc_id").agg(F.collect_list(row).alias("s"))  # bounded by the document's own length
    by_doc = by_doc.select("doc_id", *(F.col(f"s.{c}").alias(f"{c}s") for c in ("anchor", "part", "hot", "first", "last")))
    bytes_ = docs.join(by_doc, "doc_id").mapInArrow(_segment_bytes, "anchor long, part int, hot boolean, doc_id long, first int, bytes binary")
    sorted_ = bytes_.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    matched = scratch.table(sorted_.mapInArrow(_matched, MATCH), "matched")
    runs = matched.where("anchor is null").select("doc_id", "first", "last")
    lone = matched.where("anchor is not null")
    least = lone.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count("*").alias("c")).where("c > 1")
    crossing = lone.join(least, ["anchor", "window"]).where(F.struct("doc_id", "first") > F.col("least")).select("doc_id", "first", "last")
    return whole.union(runs).union(crossing)


def _marked(docs: DataFrame) -> DataFrame:
    """All rows with two more columns at the end: the first and the last of each run of repeated windows."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    key, spans, firsts, lasts = (free_name(docs, x) for x in ("_key", "_spans", "_firsts", "_lasts"))
    keyed, _ = with_row_keys(docs, key, scratch)
    windows = repeated_windows(keyed.select(F.col(key).alias("doc_id"), "text"), scratch)
    by_doc = windows.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first", "last")).alias(spans))
    marked = keyed.join(by_doc, key, "left").withColumns({firsts: F.col(f"{spans}.first"), lasts: F.col(f"{spans}.last")})
    none = F.expr("cast(null as array<int>)")
    rest = docs.where("doc_id is null").withColumns({firsts: none, lasts: none})
    return marked.select(*docs.columns, firsts, lasts).union(rest)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document with its repeated bytes removed.

    A byte goes if a window of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or before in the same
    document. Null texts are empty. Rows that share a doc_id are ordered by a hash of their text; rows without one keep all bytes.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            texts, firsts, lasts = (batch.column(k) for k in (1, 2, 3))
            for k in range(batch.num_rows):
                raw = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
                spans = _spans(raw, firsts[k].as_py(), lasts[k].as_py())
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                for column, value in zip(columns, (len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()), strict=True):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return marked.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The same rows and columns with repeated passages cut out of `text`, at whole characters.

    Null texts stay null and empty ones empty. Rows that share a doc_id are ordered by a hash of their text, so all but the
    first of equal rows lose their text; rows without a doc_id take no part and stay as they are. Further columns are kept,
    whatever their names.
    """
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (firsts, lasts) = batch.column(place).to_pylist(), batch.columns[-2:]
            for k, text in enumerate(texts):
                spans = _spans((raw := text.encode()), firsts[k].as_py(), lasts[k].as_py()) if text and firsts[k].is_valid else ()
                if spans:
                    pieces, at = [], 0
                    for a, b in spans:
                        while a < b and raw[a] & 0xC0 == 0x80:  # inside a character: that one stays
                            a += 1
                        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        pieces.append(raw[at:a])
                        at = b
                    texts[k] = b"".join([*pieces, raw[at:]]).decode()
            columns = batch.columns[:-2]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    marked = _marked(docs)
    return marked.mapInArrow(run, schema)
