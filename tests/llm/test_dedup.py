"""Near duplicates, repeated passages, vector search and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from histoframe.llm import inner_product as V
from histoframe.llm import near_dedup as N
from histoframe.llm import suffix_dedup as D

from .conftest import SMALL, TEXTS


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for k in s for j in holders[k]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for k in s:
            holders[k].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(n, seed):
    """Near copies of one text with up to a third of their words changed, so that many pairs lie near the limit."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(90)]
    out = []
    for k in range(n):
        words = base[:]
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(90)] = f"n{rng.random()}"
        out.append((50_000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, nothing, words, percent, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "FAMILY_BLOCK", 16)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in TEXTS] + family(150, 2)
    got = {r.doc_id: r for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    want = brute_components(rows, words, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert N.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(docs):
    again = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") == 8, F.lit(None)).otherwise(F.col("doc_id")))
    kept = N.keep_one_of_each(again)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids.pop(None) == 2 and set(ids.values()) == {1}
    assert {0, 1, 2, 14} & set(ids) == {0} and {3, 4, 5, 6, 9, 11} <= set(ids)


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(bool(g) and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_repeats_against_all_windows(spark, nothing, hot, monkeypatch):
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "BLOCK_BYTES", 5_000)
    passage = "shared passage of some length that stands in many documents, word for word, again and again and then once more. "
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(80).collect()] + [(10_000 + i, t) for i, t in TEXTS if i != 6]
    rows += [(20_000 + k, "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60))) + passage * rng.randint(1, 2) + f"é{k}" * 9) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.repeat_report(df).collect()}
    assert got == brute_repeats(rows)
    assert D.repeat_report(nothing).count() == 0


def test_merged_transforms_find_equal_windows():
    rng = random.Random(8)
    for _ in range(12):
        base = bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(100, 240)))
        strings = []
        for _ in range(rng.randint(1, 30)):
            s = bytearray(base)
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = rng.choice(b"abz")
            strings.append(bytes(s))
        want = defaultdict(list)
        for k, s in enumerate(strings):
            for i in range(len(s) - 99):
                want[s[i : i + 100]].append((k, i))
        found = defaultdict(list)
        for k, i, block in zip(*(x.tolist() for x in D.repeated_intervals(strings))):
            found[block].append((k, i))
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_cut_repeats_keeps_columns_and_characters(docs):
    out = D.cut_repeats(docs.union(docs.where("doc_id = 0")).withColumn("doc_id", F.when(F.col("doc_id") == 9, F.lit(None)).otherwise(F.col("doc_id"))))
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.where("doc_id <> 0").collect()}
    assert text[1] == "" and text[4] is None and text[7] == dict(TEXTS)[7] and text[10].startswith("prefix here ") and len(text[10]) < 60


def test_common_prefixes_of_the_merged_order():
    rng = random.Random(9)
    for letters in (b"a", b"ab", bytes(range(256))):
        base = bytes(rng.choice(letters) for _ in range(160))
        strings = [base[rng.randint(0, 20) :] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(12)]
        string, offset, common, q = D.merged_order(strings)
        order = [strings[k][i:] for k, i in zip(string.tolist(), offset.tolist())]
        for before, now, shared in zip(order, order[1:], common[1:].tolist()):
            ends = [*before[:100], -1], [*now[:100], -1]
            assert ends[0][:100] <= ends[1][:100] or shared >= 100
            same = next((k for k, (x, y) in enumerate(zip(before, now)) if x != y), min(len(before), len(now)))
            if shared >= 100:
                assert before[:100] == now[:100]
            else:
                assert shared <= same < shared + q or before == now


def test_repeats_of_long_texts_odd_ids_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 500)
    monkeypatch.setattr(D, "SLICE", 3_000)
    rows = [(i, t) for i, t in TEXTS] + [(2**62, TEXTS[6][1]), (2**63 - 1, "x" + TEXTS[6][1][500:9000]), (-(2**63), TEXTS[6][1][3000:3600])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_repeats(rows)
    names = "_key long, _firsts string, _lasts string, _spans int, first int, _Part int, _tie int, _base int, anchor long, segment long"
    odd = [(i, t, *([k] * 1), "f", "l", *([k] * 7)) for k, (i, t) in enumerate([(2**62, "a" * 300), (2**62, "b" * 300), (2**62, "a" * 300), (None, "a" * 300), (7, None), (7, "")])]
    df = spark.createDataFrame(odd, f"doc_id long, text string, {names}")
    out = D.cut_repeats(df)
    assert out.columns == df.columns
    texts = sorted((r.doc_id or 0, r.text if r.text is None else len(r.text), r._firsts) for r in out.collect() if r.text is not None)
    assert texts == [(0, 300, "f"), (7, 0, "f"), (2**62, 0, "f"), (2**62, 1, "f"), (2**62, 1, "f")]


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    names = "_key string, _place int, component long, kept boolean, n_shingles string"
    texts = [(5, "one two three four five six seven"), (5, "eight nine ten eleven twelve more words"), (5, "one two three four five six seven"), (5, None), (5, None), (2**62, "ONE two three four five six seven"), (None, "one two three four five six seven"), (6, "")]
    df = spark.createDataFrame([(i, t, "k", k, 1, True, "s") for k, (i, t) in enumerate(texts)], f"doc_id long, text string, {names}")
    out = N.keep_one_of_each(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({texts[0]: 1, texts[1]: 1, (5, None): 1, texts[6]: 1, (6, ""): 1})


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x[100:500] = x[100]  # a vector that many rows share
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 15 + [None], 1), (None, [1.0] * 16, 1), (2080, [1.0, 2.0], 1), (40, x[40].tolist(), 2)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")


def test_inner_product_search(spark, vectors, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 256)
    monkeypatch.setattr(V, "CHUNK", 16)
    x, df = vectors
    got = defaultdict(list)
    for r in V.nearest_by_inner_product(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, rows in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(r.score == pytest.approx((x[q] * x[r.vec_id]).sum()) and r.vec_id != q for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len(set(want.tolist()) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in V.nearest_by_inner_product(few).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert V.nearest_by_inner_product(few.where("false")).count() == 0


def test_inner_product_search_on_odd_rows(spark, monkeypatch):
    """Lists whose rows hardly differ beside the codewords' scale, and queries that aren't drawn as the other rows are."""
    monkeypatch.setattr(V, "RERANK", 40)
    rng = np.random.default_rng(3)
    tight = rng.normal(size=(4, 16))[rng.integers(0, 4, 3000)] * 5 + 1e-4 * rng.normal(size=(3000, 16))
    wide = 3 * rng.normal(size=(1000, 16))
    apart = rng.normal(size=(4000, 16)) * np.exp(np.linspace(1, -1, 16))
    apart[::20] = rng.normal(size=(200, 16)) * np.exp(np.linspace(-3, 3, 16))
    for x in (np.vstack([tight, wide])[rng.permutation(4000)], apart):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for r in V.nearest_by_inner_product(df).collect():
            got[r.query_id].add(r.vec_id)
        hits = 0
        for q in range(0, 4000, 20):
            s = (x * x[q]).sum(1)
            s[q] = -np.inf
            hits += len(got[q] & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
        assert hits >= 0.95 * 20 * 200


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == before
    assert corpus_pipeline.ORACLE_SQL is None
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_pipeline_stages_on_odd_tables(spark):
    """Null, empty and very long texts, repeated rows and ids, null ids, and columns named as stages name their own."""
    prose = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 1500").orderBy("doc_id").limit(6).collect()]
    key = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    texts = [(1, prose[0]), (1, prose[0]), (1, prose[1]), (2, None), (2, None), (3, ""), (4, prose[0]), (None, prose[2]), (None, prose[2]), (5, f"{prose[3]} my token={key} here"), (6, " ".join(prose) * 40), (7, "one")]
    names = ("kept", "Ratio", "_key", "_tie", "n_words", "component_id", "spans", "start", "sequence_id", "id", "shard", "secret")
    rows = [(i, t, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, SMALL)
        if name != "packing":
            assert out[name].columns == docs.columns, name
            held = {r.kept: r for r in docs.collect()}
            for r in out[name].collect():  # every row is one of the table's, but for its text
                assert r.doc_id == held[r.kept].doc_id and r[2:] == held[r.kept][2:], name
                assert name in ("suffix_dedup", "secret_scans") or r.text == held[r.kept].text, name
    kept = {n: sorted(int(r.kept[4:]) for r in out[n].collect()) for n in ("quality_rules", "near_dedup", "suffix_dedup", "secret_scans")}
    assert not {3, 4, 5, 11} & set(kept["quality_rules"]) and len({0, 1} & set(kept["quality_rules"])) != 1
    assert len({0, 1} & set(kept["near_dedup"])) == 1 and len({3, 4} & set(kept["near_dedup"])) == 1
    assert {2, 5, 7, 8, 9, 10, 11} <= set(kept["near_dedup"]) and 6 not in kept["near_dedup"]
    assert kept["suffix_dedup"] == kept["secret_scans"] == list(range(len(rows)))
    cut = {int(r.kept[4:]): r.text for r in out["suffix_dedup"].collect()}
    assert cut[3] is None and cut[5] == "" and cut[6] == "" and cut[7] == cut[8] == prose[2] and len(cut[10]) < len(texts[10][1]) / 30
    red = {int(r.kept[4:]): r.text for r in out["secret_scans"].collect()}
    assert key not in red[9] and red[3] is None and red[5] == "" and red[11] == "one"
    pieces = out["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in texts} and {r.doc_id: r.n for r in pieces}[2] == 2
