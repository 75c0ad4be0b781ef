"""Secret scans: patterns for known kinds, and character Markov models for random strings of no known kind.

Two order-1 models over characters, one of random strings and one of ordinary identifiers, are counted on labelled
samples. In each run of key characters, less what the patterns cover, the window of the largest log-likelihood ratio
between the models is a secret if its ratio per character exceeds the limit for its length, set on the same samples above
the best windows of all but a few identifiers; so keys and paths around a secret don't dilute it. A window grows to the
ends of its words, and the rest of the run is searched again. Spans never overlap those of the patterns.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoframe.llm.encoder import slices

#: The patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same spans as AKIA[A-Z0-9]+ of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as [0-9a-f]+ of 24 or more characters
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the models: runs of these characters, and the lengths from which windows in them have limits of their own.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LENGTHS = (16, 20, 24, 32, 48)
SHORTEST = LENGTHS[0]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, by start, then kind as listed."""
    found = []
    lowered = text.encode().lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def cover(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a text that spans sorted by start cover, as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of runs that could hold random strings: what `taken` leaves of each, where that is long enough.

    Runs and taken intervals are both in order and are walked through once, side by side.
    """
    out = []
    covered, first = cover(taken), 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        k = first
        while k < len(covered) and covered[k][0] < m.end():
            a, b = covered[k]
            if a - at >= SHORTEST:
                out.append((at, a))
            at = max(at, b)
            k += 1
        if m.end() - at >= SHORTEST:
            out.append((at, m.end()))
    return out


_CODE = np.full(256, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
WIDTH = len(ALPHABET) + 1
#: Windows without letters are numbers, dates and ruled lines, which order-1 models can't tell from random digits and marks.
_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
#: Numbers in one matrix of windows, at about which many short runs are judged together.
CELLS = 1 << 18


def transitions(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the transition table that the tokens pass, one token after another, and how many for each token."""
    raw = np.frombuffer("\n".join(tokens).encode("ascii", "replace"), np.uint8)
    codes = _CODE[raw]
    cells = codes[:-1] * WIDTH + codes[1:]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(cells), bool)
    joins = starts[1:] - 1
    inside[joins] = inside[joins - 1] = False
    return cells[inside], np.maximum(lengths - 1, 0)


def counted(tokens: list[str]) -> np.ndarray:
    """Transitions of the tokens, counted by cell of the table."""
    return np.bincount(transitions(tokens)[0], minlength=WIDTH * WIDTH) if tokens else np.zeros(WIDTH * WIDTH, np.int64)


def log_model(counts: np.ndarray, prior: float = 0.5) -> np.ndarray:
    """Log probabilities of the next character given the one before, with additive smoothing."""
    table = (counts + prior).reshape(WIDTH, WIDTH)
    return np.log(table / table.sum(1, keepdims=True)).ravel()


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled random strings over the alphabets in which keys are written."""
    rng = np.random.default_rng(seed)
    sets = [ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "0123456789abcdef"]
    return ["".join(rng.choice(list(sets[k % len(sets)]), int(rng.integers(20, 64)))) for k in range(n)]


class MarkovPair:
    """The difference of the two models' log probabilities, and the limit per character."""

    def __init__(self, secrets: np.ndarray, identifiers: np.ndarray, limit: float = 1.0):
        self.ratio = log_model(secrets) - log_model(identifiers)
        self.limit = limit
        self.limits = [limit] * len(LENGTHS)

    def score(self, tokens: list[str]) -> np.ndarray:
        """Mean log-likelihood ratio per transition of each token."""
        if not tokens:
            return np.zeros(0)
        cells, counts = transitions(tokens)
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[cells])])
        ends = np.cumsum(counts)
        return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


    def gains(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running log-likelihood ratios of the tokens, one after another; each one's start among them, and its length."""
        cells, counts = transitions(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.concatenate([[0.0], np.cumsum(self.ratio[cells])]), np.cumsum(counts) - counts, lengths

    def best_windows(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, mean ratio) of each token's window of the largest ratio, the first of equals; tokens have SHORTEST
        characters or more. Tokens of about one length are judged together as rows of a matrix."""
        starts, stops, means = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        if not tokens:
            return starts, stops, means
        gains, first, lengths = self.gains(tokens)
        order = np.argsort(lengths, kind="stable")
        rising, at = lengths[order], 0
        while at < len(order):
            shortest = rising[at]
            stop = min(np.searchsorted(rising, shortest * 5 // 4, "right"), at + max(1, CELLS // int(shortest)))
            rows = order[at:stop]
            width = int(lengths[rows].max()) - SHORTEST + 1
            place = np.arange(width)
            outside = place >= (lengths[rows] - SHORTEST + 1)[:, None]
            where = np.minimum(first[rows][:, None] + place, len(gains) - SHORTEST)
            low, high = gains[where], gains[where + SHORTEST - 1]
            rise = np.where(outside, -np.inf, high - np.minimum.accumulate(low, axis=1))
            last = rise.argmax(1)
            start = np.where(place > last[:, None], np.inf, low).argmin(1)
            starts[rows], stops[rows] = start, last + SHORTEST
            line = np.arange(len(rows))
            means[rows] = (high[line, last] - low[line, start]) / (last + SHORTEST - 1 - start)
            at = stop
        return starts, stops, means

    def best_of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, mean ratio) of the window with the largest mean of each token's best one and those of its parts."""
        spans = [[(0, len(t)), *(m.span() for m in _PART.finditer(t) if m.end() - m.start() < len(t))] for t in tokens]
        starts, stops, means = self.best_windows([t[a:b] for t, x in zip(tokens, spans, strict=True) for a, b in x])
        offsets = np.array([a for x in spans for a, _ in x], np.int64)
        owner = np.repeat(np.arange(len(tokens)), [len(x) for x in spans])
        order = np.lexsort((np.arange(len(owner)), -means, owner))
        first = order[np.unique(owner[order], return_index=True)[1]]
        return starts[first] + offsets[first], stops[first] + offsets[first], means[first]

    def passes(self, start: int, end: int, mean: float, letters: np.ndarray) -> bool:
        """Whether a window's ratio exceeds the limit of its length and it has a letter; `letters` counts those before a place."""
        return mean > self.limits[_length_class(end - start)] and bool(letters[end] > letters[start])

    def found_in(self, tokens: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of secrets in each run, in order, which don't overlap; = parts keys from values and ends a value as padding.

        The best windows of all values and of their parts between slashes are judged together. A value without a window that
        passes has no secret; the others are searched further in a time that grows with their lengths.
        """
        values = [[m.span() for m in _VALUE.finditer(t)] for t in tokens]
        parts = [[m.span() for m in _PART.finditer(t)] for t in tokens]
        pieces = [t[a:b] for spans in (values, parts) for t, x in zip(tokens, spans, strict=True) for a, b in x]
        judged = zip(*(x.tolist() for x in self.best_windows(pieces)), strict=True)
        windows = [[[(a + s, a + e, m) for (a, _), (s, e, m) in zip(x, judged, strict=False)] for x in spans] for spans in (values, parts)]
        out = []
        for token, whole, wholes, part, inner in zip(tokens, values, windows[0], parts, windows[1], strict=True):
            letters = None
            spans: list[tuple[int, int]] = []
            if any(m > self.limits[_length_class(e - s)] for x in (wholes, inner) for s, e, m in x):
                letters = np.concatenate([[0], np.cumsum(_LETTER[np.frombuffer(token.encode("ascii"), np.uint8)])])
                passing = [(*span, w) for span, w in zip(part, inner, strict=True) if self.passes(*w, letters)]
                if passing or any(self.passes(*w, letters) for w in wholes):
                    spans = sorted(self._search(token, whole, part, passing, letters))
            out.append(spans)
        return out

    def _search(self, token: str, values: list, parts: list, passing: list, letters: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans in a run: in each stretch the best window, or else the first that passes of those of its parts between slashes,
        grown to the ends of its words; then what lies left and right of it. Whole parts are judged already: `passing`."""
        rises = _Rises(self.gains([token])[0])
        part_starts, pass_starts = [a for a, _ in parts], [a for a, _, _ in passing]

        def ask(a: int, b: int) -> Iterator[tuple[int, int, float]]:
            yield rises.best(a, b)
            k = bisect.bisect_left(part_starts, a) - 1
            if k >= 0 and SHORTEST <= parts[k][1] - a and parts[k][1] < b:  # a part that the stretch cuts at its left
                yield rises.best(a, parts[k][1])
            k = bisect.bisect_left(pass_starts, a)
            if k < len(passing) and passing[k][1] <= b:
                yield passing[k][2]
            k = bisect.bisect_left(part_starts, b) - 1
            if k >= 0 and a < parts[k][0] and b < parts[k][1] and SHORTEST <= b - parts[k][0]:
                yield rises.best(parts[k][0], b)

        left = list(values)
        while left:
            a, b = left.pop()
            hit = next((w for w in ask(a, b) if self.passes(*w, letters)), None)
            if hit is not None:
                start, end, _ = hit
                while start > a and token[start - 1].isalnum():
                    start -= 1
                while end < b and token[end].isalnum():
                    end += 1
                while end == b < len(token) and token[end] == "=":
                    b += 1
                    end += 1
                yield start, end
                left += [x for x in ((a, start), (end, b)) if x[1] - x[0] >= SHORTEST]


class _Rises:
    """The window of the largest rise in any stretch of a run, from what is known of blocks of its places.

    A window from place l to the character k + SHORTEST - 1 has l <= k and rises by high[k] - low[l]. Of each block the
    lowest low, the highest high and the largest rise inside are known, so a stretch costs two blocks and one row of numbers.
    """

    def __init__(self, gains: np.ndarray, size: int = 256):
        self.low, self.high, self.size = gains[: len(gains) - SHORTEST + 1], gains[SHORTEST - 1 :], size
        whole = len(self.low) // size
        low, high = (x[: whole * size].reshape(whole, size) for x in (self.low, self.high))
        rise = high - np.minimum.accumulate(low, axis=1)
        self.lowest, self.highest, self.largest = low.min(1), high.max(1), rise.max(1)
        self.inside, self.top = rise.argmax(1), high.argmax(1)

    def best(self, a: int, b: int) -> tuple[int, int, float]:
        """(start, end, mean ratio) of the window of the largest ratio in the characters from a to b."""
        stop, size = b - SHORTEST + 1, self.size
        first, last = -(-a // size), stop // size
        if last - first < 2:
            k = a + int((self.high[a:stop] - np.minimum.accumulate(self.low[a:stop])).argmax())
        else:
            left, right = slice(a, first * size), slice(last * size, stop)
            found = []
            if left.start < left.stop:
                rise = self.high[left] - np.minimum.accumulate(self.low[left])
                found.append((float(rise.max()), a + int(rise.argmax())))
            before = self.low[left].min() if left.start < left.stop else np.inf
            lows = np.minimum.accumulate(np.concatenate([[before], self.lowest[first:last]]))
            across = self.highest[first:last] - lows[:-1]
            rises = np.maximum(across, self.largest[first:last])
            block = int(rises.argmax())
            top = self.top if across[block] > self.largest[first + block] else self.inside
            found.append((float(rises[block]), (first + block) * size + int(top[first + block])))
            if right.start < right.stop:
                rise = self.high[right] - np.minimum(np.minimum.accumulate(self.low[right]), lows[-1])
                found.append((float(rise.max()), right.start + int(rise.argmax())))
            k = max(found, key=lambda x: x[0])[1]
        start = self._lowest(a, k + 1)
        return start, k + SHORTEST, float(self.high[k] - self.low[start]) / (k + SHORTEST - 1 - start)

    def _lowest(self, a: int, stop: int) -> int:
        """The first place of the lowest low from a on, before `stop`."""
        first, last = -(-a // self.size), stop // self.size
        if last - first < 2:
            return a + int(self.low[a:stop].argmin())
        block = first + int(self.lowest[first:last].argmin())
        bounds = [(a, first * self.size), (block * self.size, (block + 1) * self.size), (last * self.size, stop)]
        places = [x + int(self.low[x:y].argmin()) for x, y in bounds if x < y]
        return min(places, key=lambda k: (self.low[k], k))


def _length_class(length: int) -> int:
    return bisect.bisect_right(LENGTHS, length) - 1


_VALUE = re.compile(r"[^=]{16,}")
_PART = re.compile(r"[^/=]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z_/-]{6,}")


def train(docs: DataFrame, floor: float = 1.0, window_floor: float = 1.0) -> MarkovPair:
    """Fit the models on labelled examples from every document.

    Their pattern hits are labelled secrets, beside generated random strings; their words outside these, alone and joined
    by _, - and / in threes or in mixed case in pairs with a number, are labelled identifiers, from all of each text. Tasks
    count transitions, and then the identifiers' scores by hundredths;
    only these tables come to the driver. The limit is the 99.9th percentile of the identifiers' scores, `floor` at least;
    those of windows are that of the identifiers' best windows of a length or more, `window_floor` at least.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[str]]]:
        for batch in batches:
            for some in slices(batch.column(0).to_pylist()):
                pairs = [_labelled(t) for t in some]
                yield [[x for pair in pairs for x in pair[k]] for k in range(2)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, WIDTH * WIDTH), np.int64)
        for both in labelled(batches):
            for k in range(2):
                totals[k] += counted(both[k])
        k, cells = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict({"secret": pa.array(k == 0), "cell": pa.array(cells), "n": pa.array(totals[k, cells])})

    texts = docs.where(F.col("text").isNotNull()).select("text")
    tables = np.zeros((2, WIDTH * WIDTH), np.int64)
    for r in texts.mapInArrow(count, "secret boolean, cell long, n long").groupBy("secret", "cell").agg(F.sum("n").alias("n")).collect():  # a table's cells
        tables[0 if r.secret else 1, r.cell] = r.n
    model = MarkovPair(tables[0] + counted(random_strings(6_000)), tables[1])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for _, identifiers in labelled(batches):
            best = model.best_of([x for x in identifiers if len(x) >= SHORTEST])
            kinds = np.concatenate([np.full(len(identifiers), -1), np.searchsorted(LENGTHS, best[1] - best[0], "right") - 1]).astype(np.int64)
            steps = np.ceil(np.concatenate([model.score(identifiers), best[2]]) * 100).astype(np.int64)
            for cell, n in zip(*(x.tolist() for x in np.unique((kinds + 1 << 32) + steps + (1 << 31), return_counts=True)), strict=True):
                totals[cell] = totals.get(cell, 0) + n
        cells, n = np.array(list(totals), np.int64), np.array(list(totals.values()), np.int64)
        yield pa.RecordBatch.from_pydict({"kind": pa.array((cells >> 32) - 1), "step": pa.array((cells & (1 << 32) - 1) - (1 << 31)), "n": pa.array(n)})

    steps = texts.mapInArrow(rate, "kind long, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).orderBy("step").collect()  # hundredths of a score by length
    model.limit = _percentile([(r.step, r.n) for r in steps if r.kind < 0], floor)
    model.limits = [_percentile([(r.step, r.n) for r in steps if r.kind >= k], window_floor) for k in range(len(LENGTHS))]
    return model


def _percentile(steps: list[tuple[int, int]], floor: float) -> float:
    """The 99.9th percentile of scores counted by hundredths in rising order, `floor` at least."""
    total, below = sum(n for _, n in steps), 0
    for step, n in steps:
        below += n
        if below >= 0.999 * total:
            return max(floor, step / 100)
    return floor


def _labelled(text: str) -> tuple[list[str], list[str]]:
    """A text's labelled secrets and identifiers."""
    hits = base_spans(text)
    secrets = [re.split(r"[^A-Za-z0-9+/_=-]", text[a:b])[-1] for a, _, b in hits]
    covered, first, words = cover(hits), 0, []
    for m in _IDENTIFIER.finditer(text):
        while first < len(covered) and covered[first][1] <= m.start():
            first += 1
        if first == len(covered) or covered[first][0] >= m.end():
            words.append(m[0])
    joined_ = [j.join(x) for j, x in zip(itertools.cycle("_-/"), zip(words[::3], words[1::3], words[2::3], strict=False), strict=False)]
    camel = ["".join(w.capitalize() for w in x) + str(len(x[0])) for x in zip(words[::3], words[1::3], strict=False)]
    return [x for x in secrets if len(x) >= 12], words + joined_ + camel


def find_spans(texts: list[str], model: MarkovPair) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all secrets in each text."""
    found = [base_spans(t) for t in texts]
    runs = [(k, a, b) for k, (text, spans) in enumerate(zip(texts, found, strict=True)) for a, b in candidates(text, spans)]
    for (k, at, _), hits in zip(runs, model.found_in([texts[k][a:b] for k, a, b in runs]), strict=True):
        found[k] += [(at + a, 3, at + b) for a, b in hits]
    return [sorted(x) for x in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """Spans of secrets in every whole text, in code points, one row a document.

    Null and empty texts give no spans; null ids and repeated rows stay as rows; no further column is read, whatever its name;
    an empty table gives none. Time grows with a text's length, also for one long run of key characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(batch.column(1).to_pylist()):
                spans = find_spans([t or "" for t in some], model)
                base = [[s for s in x if s[1] < 3] for x in spans]
                columns = [batch.column(0).slice(at, len(some))]
                columns += [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
                columns += [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in spans])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])
                at += len(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, model: MarkovPair, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by `mark`.

    Null texts stay null, empty ones empty; repeated rows and null ids stay; columns of any name pass through; an empty
    table stays empty. Where spans overlap, the earlier one is replaced and the rest of the later one goes with it.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(batch.column(place).to_pylist()):
                out = []
                for text, spans in zip(some, find_spans([t or "" for t in some], model), strict=True):
                    if spans:
                        pieces, done = [], 0
                        for start, _, end in spans:
                            if start >= done:
                                pieces += [text[done:start], mark]
                            done = max(done, end)
                        text = "".join([*pieces, text[done:]])
                    out.append(text)
                part = batch.slice(at, len(some))
                columns = part.columns
                columns[place] = pa.array(out, batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
                at += len(some)

    return docs.mapInArrow(run, docs.schema)
