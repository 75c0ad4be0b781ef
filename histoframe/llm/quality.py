"""Quality rules: word and line rules first, then compression bands.

The compression ratio of a text is its zstandard size by its size in bytes. Repetitive text compresses far below ordinary
prose and random text hardly at all, and both limits depend on length, as a short text has little to repeat and a frame
of fixed size. `WHOLE_BANDS` holds (bytes below which it applies, lowest ratio, highest ratio) for the whole text. Each
chunk of `CHUNK_BYTES` bytes must lie within `CHUNK_BAND`, the band of that length, too: all full chunks, and where they
leave a rest, the chunk that ends with the text. This finds runs of repetition or noise that the whole text hides. None
is tolerated: random base64 has about 0.77 at this length, and the chunks of clean prose lie near 0.5, far within the
band. No text is cut for this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.encoder import slices
from histoframe.llm.keys import free_name

WHOLE_BANDS = ((64, 0.0, float("inf")), (256, 0.45, 1.30), (1024, 0.40, 0.90), (4096, 0.32, 0.80), (16384, 0.28, 0.75), (float("inf"), 0.25, 0.75))
CHUNK_BYTES = 2048
CHUNK_BAND = (0.25, 0.75)
LEVEL = 3
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, kept boolean"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the list, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    seen: dict[tuple[bytes, ...], int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    twice: set[tuple[bytes, ...]] = set()
    places = np.flatnonzero(alike).tolist()
    keys = [tuple(words[i : i + window]) for i in places]
    for key in keys:  # the words themselves decide, not their hashes
        seen[key] = seen.get(key, 0) + 1
        if seen[key] == 2:
            twice.add(key)
    for i, key in zip(places, keys, strict=True):
        if key in twice:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole text, chunks out of the band, and whether both rules pass. An empty text has ratio 0."""
    if not raw:
        return 0.0, 0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    _, low, high = next(b for b in WHOLE_BANDS if len(raw) < b[0])
    starts = [*range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if starts and len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    bad = 0
    for at in starts:
        share = len(compressor.compress(raw[at : at + CHUNK_BYTES])) / CHUNK_BYTES
        bad += not CHUNK_BAND[0] <= share <= CHUNK_BAND[1]
    return ratio, bad, low <= ratio <= high and not bad


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """One row of SCHEMA for a whole text; null is empty and has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only, as bytes
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_repeat = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    ratio, bad, passed = compression(raw, compressor)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        n_repeat,
        base_failed,
        ratio,
        bad,
        passed and not base_failed,
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """The table with the columns of SCHEMA added for its whole `text`; columns of those names are replaced.

    Every row stays, with its own verdict in `kept`; nulls and texts without words fail the base rule.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    docs = docs.drop(*names)
    place = docs.columns.index("text")
    schema = docs.limit(0).selectExpr("*", *(f"cast(null as {kind}) {name}" for name, kind in (x.split() for x in SCHEMA.split(", ")))).schema
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            at = 0
            for some in slices(batch.column(place).to_pylist()):
                rows = [measure(t, compressor) for t in some]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns, *columns], [*batch.schema.names, *names])
                at += len(some)

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """Measures and verdicts alone, one row a row of the table: null and empty texts have no words and fail the base rule, null
    ids and repeated rows stay, further columns are left out, an empty table gives no rows."""
    return quality_rules(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows whose whole text passes, with the columns of the table alone, whatever their names.

    Nulls and texts without words don't pass; repeated rows each have their own verdict; an empty table gives no rows.
    """
    measured = [x.split()[0] for x in SCHEMA.split(", ")]
    renamed, own = docs, {}
    for c in docs.columns:
        if c.lower() in measured:
            own[c] = free_name(renamed, f"_own_{c}")
            renamed = renamed.withColumnRenamed(c, own[c])
    kept = quality_rules(renamed).where("kept").drop(*measured)
    return kept.withColumnsRenamed({b: a for a, b in own.items()})
