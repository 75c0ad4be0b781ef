"""Lexical search, conversation repair and SimHash against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from histoframe.llm import conversations as C
from histoframe.llm import lexical as X
from histoframe.llm import simhash as H

from .conftest import SMALL, TEXTS


def small_documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


# --- ranked lexical search


def plain_ranking(rows, items, k):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    counts = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for place, (_, text) in enumerate(items):
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        scores = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * len(counts) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score:
                scores.append((-score, i is None, i or 0))
        out[place] = [(None if none else i, -s) for s, none, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("leaf, postings", [(1, 40), (4, 700), (32, 1_000_000)])
def test_ranking_against_all_scores(spark, monkeypatch, leaf, postings):
    rows = small_documents(spark) + [(10_000 + i, t) for i, t in TEXTS]
    rows += [(20_000 + k, rows[5][1]) for k in range(70)] + [(7, rows[3][1]), (None, rows[4][1])]  # ties beyond k, a repeated and a null id
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "zzzz-unseen"), (903, rows[5][1]), (903, "東京タワー WORD1 word2"), (None, "the word3 one")]
    monkeypatch.setattr(X, "LEAF", leaf)
    monkeypatch.setattr(X, "TREE_POSTINGS", postings)
    docs = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, rank int, Score int").repartition(3)
    got = defaultdict(list)
    for r in X.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), 50).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    want = plain_ranking(rows, items, 50)
    by_id = defaultdict(list)
    for place, (i, _) in enumerate(items):
        by_id[i] += [(n + 1, d, s) for n, (d, s) in enumerate(want[place])]
    key = lambda x: (x[0], x[2], x[1] is None, x[1] or 0)
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(v, key=key) for i, v in by_id.items() if v}


def test_ranking_in_item_blocks_and_without_rows(spark, docs, nothing, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    once = sorted(map(tuple, X.rank_documents(documents, items, 5).collect()))
    monkeypatch.setattr(X, "ITEM_BYTES", 2000)
    assert sorted(map(tuple, X.rank_documents(documents, items, 5).collect())) == once
    assert X.rank_documents(nothing, items).count() == 0 and X.rank_documents(docs, items.where("false")).count() == 0


def test_tree_cuts_subtrees(spark):
    """Bounds hold for all documents below a node, and a search for a rare term scores few leaves."""
    import numpy as np

    rng = np.random.default_rng(3)
    paths = sorted(np.unique(np.concatenate([np.flatnonzero(rng.random(60) < 0.4), [60 + k % 200]])).astype(">u4").tobytes() for k in range(4000))
    tfs = rng.integers(1, 9, sum(len(p) // 4 for p in paths))
    tree = X.Tree(np.arange(4000), rng.integers(50, 300, 4000), paths, tfs, 260)
    term, weight = np.array([3, 70, 199]), np.array([40, 900, 1000])
    bound = tree.bounds(np.arange(len(tree.ranges)), term, weight)
    own = np.zeros(4000, np.int64)
    for k in range(4000):
        a, b = tree.cuts[k], tree.cuts[k + 1]
        for t, w in zip(term, weight):
            hit = np.flatnonzero(tree.term[a:b] == t)
            own[k] += X._scores(w, tree.tf[a:b][hit], tree.m[k]).sum()
    assert all(bound[n] >= own[a:b].max() for n, (a, b) in enumerate(tree.ranges))
    scored = []
    whole = X._scores
    try:
        X._scores = lambda w, tf, m: (scored.append(tf.size), whole(w, tf, m))[1]
        none = np.zeros(0, np.int64)
        scores, ids = tree.search(term, weight, (none, none), 10, np.full(260, -1))
    finally:
        X._scores = whole
    order = np.lexsort((np.arange(4000), -own))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == own[order].tolist()


# --- conversations

S, U, A = "system", "user", "assistant"


def facts_of(rows):
    """Rows (role, text) in order to (initial, must go, truncated) and the counts of faults."""
    seen, out, faults = set(), [], Counter()
    for role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return out, faults


def plain_repair(rows):
    """The cheapest edits, ASCII-least, over whole strings of edits from each place and state to the end."""
    kinds, faults = facts_of(rows)
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}  # (row, state) to (cost, audit), from the end on; a third insertion in a row never pays
    for k in range(len(rows), -1, -1):
        for left in range(3):
            for state in ("", "s", "u", "a"):
                ways = [(0, "")] if k == len(rows) and state in ("", "a") else []
                if left:
                    new = "a" if state == "u" else "u"
                    cost, audit = best[k, new, left - 1]
                    ways.append((cost + 3, "I" + audit))
                if k < len(rows):
                    initial, gone, cut = kinds[k]
                    cost, audit = best[k + 1, state, 2]
                    ways.append((cost + 4, "D" + audit))
                    if not gone:
                        new = "a" if state == "u" else "u"
                        cost, audit = best[k + 1, new, 2]
                        ways.append((cost + 3 + 3 * cut, "R" + audit))
                        if initial and initial in following[state]:
                            cost, audit = best[k + 1, initial, 2]
                            ways.append((cost + 3 * cut, "K" + audit))
                best[k, state, left] = min(ways, default=(10**9, ""))
    cost, audit = best[0, "", 2]
    lines, state, k = [], "", 0
    for letter in audit:
        new = "a" if state == "u" else "u"
        if letter == "I":
            lines.append(("assistant" if new == "a" else "user") + ":")
            state = new
            continue
        role, text = rows[k]
        k += 1
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = role[0]
        elif letter == "R":
            lines.append(("assistant" if new == "a" else "user") + f":{text}")
            state = new
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(rng, n):
    roles = [S, U, A, U, A, "tool", " ", "User", "uncle"]
    texts = ["One. ", "Two!", "cut off", "", " \t", "Three?\n"]
    return [(rng.choice(roles[: rng.choice([3, 5, 9])]), rng.choice(texts) + (str(rng.random()) + "." if rng.random() < 0.7 else "")) for _ in range(n)]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()


def test_repair_against_whole_strings():
    rng = random.Random(1)
    for k in range(3000):
        rows = random_rows(rng, rng.randint(0, 12))
        got = C.repair([r for r, _ in rows], [t for _, t in rows], [digest(*r) for r in rows])
        assert tuple(got.values()) == plain_repair(rows), rows


def test_plain_repair_against_all_strings():
    """The plain version itself, on tiny conversations: every string of edits is tried."""
    rng = random.Random(2)
    good = re.compile(r"(s?(ua)+)?")
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        kinds, _ = facts_of(rows)
        best = (10**9, "")
        for size in range(len(rows), len(rows) + 5):
            for edits in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in edits) != len(rows):
                    continue
                for chosen in itertools.product("ua", repeat=sum(e in "IR" for e in edits)):
                    pick, cost, out, k, legal = iter(chosen), 0, "", 0, True
                    for e in edits:
                        if e == "I":
                            cost, out = cost + 3, out + next(pick)
                            continue
                        initial, gone, cut = kinds[k]
                        k += 1
                        legal &= e == "D" or not gone
                        cost += {"D": 4, "K": 3 * cut, "R": 3 + 3 * cut}[e]
                        out += "" if e == "D" else next(pick) if e == "R" else initial or "?"
                    if legal and good.fullmatch(out):
                        best = min(best, (cost, "".join(edits)))
        assert plain_repair(rows)[4:6] == best


def plain_report(rows):
    """conv_id, turn, role, text to the report of repair_conversations."""
    by = defaultdict(list)
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[i].append((turn is not None, turn or 0, digest(role, text), role, text))
    out = {}
    for i, some in by.items():
        some.sort()
        known = {x[1] for x in some if x[0]}
        out[i] = (max(known) - min(known) + 1 - len(known) if known else 0, *plain_repair([x[3:] for x in some]))
    return out


def plain_damage(rows):
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(i, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def test_conversations_against_whole_strings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(4)
    for i in range(1000, 1040):
        rows += [(i, rng.choice([None, *range(5)]), *row) for row in random_rows(rng, 6)]
    rows += [(2000, k // 2, *row) for k, row in enumerate(random_rows(rng, 700))]  # a third of all rows, over many tasks
    rows += [(None, k, U, "Without an id.") for k in range(4)] + [(3000, None, None, None), (3001, 0, U, "x" * 100_000 + ".")]
    rows += rows[5:9] + rows[5:9]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gaps int, Part string").repartition(3)
    want = plain_report(rows)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(table).collect()}
    assert got == want
    left = plain_report(plain_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = C.repair_damaged(table)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert found.columns == [x.split()[0] for x in C.REPORT.split(", ")]
    assert got == {i: left.get(i, empty) for i in want}
    assert C.repair_damaged(table.where("false")).count() == 0


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_stretches_of_conversations(spark, tasks):
    """The report doesn't depend on where tasks cut conversations."""
    rng = random.Random(5)
    rows = [(i, k, *row) for i in range(6) for k, row in enumerate(random_rows(rng, 50))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_report(rows)


# --- SimHash


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, words, bits):
    prints = [plain_fingerprint(t, words) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i if i is not None else -1, f"{p:016x}", least.get(find(p), -1)) for (i, _), p in zip(rows, prints)))


def variants(n, seed):
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(400)]
    out = []
    for k in range(n):
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(400)] = f"n{rng.random()}"
        out.append((70_000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("bits, block", [(3, 4), (3, 1024), (1, 8), (5, 16)])
def test_simhash_against_all_pairs(spark, nothing, monkeypatch, bits, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rows = small_documents(spark) + [(10_000 + i, t) for i, t in TEXTS] + variants(150, 1) + [(None, "all alone here"), (None, TEXTS[0][1]), (3, "again another text"), (3, "again another text")]
    table = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, fp int, Component_id int").repartition(3)
    found = H.simhash_duplicates(table, 3, bits)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in found.collect())
    assert got == plain_components(rows, 3, bits)
    assert H.simhash_duplicates(nothing).count() == 0


def test_fingerprint_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(H, "SLICE", 7)
    assert all(H.fingerprint(t, 3) == plain_fingerprint(t, 3) for _, t in TEXTS[:6])
