"""The queries op1 to op13, each its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from histoframe.llm.conversations import repair_damaged
from histoframe.llm.html_layout import extract_text
from histoframe.llm.inner_product import nearest_by_inner_product
from histoframe.llm.language_model import score_documents
from histoframe.llm.lexical import rank_documents
from histoframe.llm.merges import bpe_round_trip
from histoframe.llm.near_dedup import near_duplicates
from histoframe.llm.packing import pack_documents
from histoframe.llm.quality import quality_report
from histoframe.llm.secrets import scan_secrets, train
from histoframe.llm.simhash import simhash_duplicates
from histoframe.llm.suffix_dedup import repeat_report
from histoframe.llm.token_files import token_files
from histoframe.session import bound_batches, ship_package

#: Vocabulary files; operators take their paths as parameters.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back; null texts are empty, rows without an id are left out, repeated rows stay."""
    return token_files(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; nulls, repeated ids and empty tables as repeat_report says."""
    return repeat_report(_table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; nulls and repeated rows as quality_report says."""
    return quality_report(_table(spark, sf_dir, "documents"))


def op4_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to; nulls and repeated rows as bpe_round_trip says."""
    return bpe_round_trip(_table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those not held out; nulls and repeated rows as score_documents says."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by models trained on their sample; nulls and repeated rows as scan_secrets says."""
    docs = _table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))


def op7_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query row; what takes no part, and ties, as nearest_by_inner_product says."""
    return nearest_by_inner_product(_table(spark, sf_dir, "embeddings"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages; nulls and repeated rows as extract_text says."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents; nulls and repeated ids as near_duplicates says."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents; nulls and repeated rows as pack_documents says."""
    return pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; nulls and ties as rank_documents says."""
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as planned and repaired; nulls and ties as repair_conversations says."""
    return repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at three bits or fewer; nulls as simhash_duplicates says."""
    return simhash_duplicates(_table(spark, sf_dir, "documents"), words=3, bits=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_files, op2_suffix_dedup, op3_compression_bands, op4_merge_replay, op5_language_model, op6_secret_scan, op7_inner_product, op8_html_layout, op9_tensored_minhash, op10_packing, op11_document_tree, op12_conversation_repair, op13_simhash)
    return {f.__name__: f for f in found}


#: All pairs of documents that share a shingle, and a recursion over their links: for small tables only.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM n UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(o) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.d = n.doc_id"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all documents that share a term with an item.
RANKED = rf"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM n),
i AS (SELECT item, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark)),
f AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM d) SEMI JOIN i USING (t) GROUP BY 1, 2),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY 1),
s AS (SELECT item, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total)))) AS BIGINT) AS score
      FROM i JOIN f USING (t) JOIN g USING (t) JOIN n USING (d), c GROUP BY item, item_id, d, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0) WHERE r <= 50"""


#: crc32 by a fold over bytes and bits; the least cost and audit of every state, row by row, with whole strings of edits.
REPAIRED = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(k) + 1), lambda j: [CAST(ascii(substr(k, j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) % 20 AS f FROM src),
cid AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
dam AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc JOIN cid ON crc.conv_id IS NOT DISTINCT FROM cid.conv_id WHERE f <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || ':' || text)) AS i FROM dam),
dup AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM ord),
rws AS (SELECT c, turn, i, role, text, left(role, 1) AS ini, CASE WHEN shown = '' THEN 'b' WHEN again THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS pair FROM dup),
ins(p, k, st, edits, lines) AS (VALUES ('', 0, '', '', []), ('', 1, 'u', 'I', ['user:']), ('', 2, 'a', 'II', ['user:', 'assistant:']), ('s', 0, 's', '', []), ('s', 1, 'u', 'I', ['user:']), ('s', 2, 'a', 'II', ['user:', 'assistant:']),
  ('u', 0, 'u', '', []), ('u', 1, 'a', 'I', ['assistant:']), ('u', 2, 'u', 'II', ['assistant:', 'user:']), ('a', 0, 'a', '', []), ('a', 1, 'u', 'I', ['user:']), ('a', 2, 'a', 'II', ['user:', 'assistant:'])),
way(st, op, ini, nx, cost) AS (VALUES ('', 'D', NULL, '', 4), ('s', 'D', NULL, 's', 4), ('u', 'D', NULL, 'u', 4), ('a', 'D', NULL, 'a', 4), ('', 'R', NULL, 'u', 3), ('s', 'R', NULL, 'u', 3), ('u', 'R', NULL, 'a', 3), ('a', 'R', NULL, 'u', 3),
  ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0)),
stp AS (SELECT p, edits || op AS edits, lines, op, ini, nx, 3 * k + cost AS cost FROM ins JOIN way USING (st)),
dp AS (SELECT c, CAST(0 AS BIGINT) AS i, '' AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS body FROM cid
  UNION ALL SELECT c, i, nx, min(b).cost, min(b).audit, min(b).body FROM (
    SELECT dp.c, rws.i, nx, {'cost': dp.cost + stp.cost + CASE WHEN fault = 't' AND op <> 'D' THEN 3 ELSE 0 END, 'audit': audit || edits,
      'body': list_concat(body, lines, CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE nx WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] END)} AS b
    FROM dp JOIN rws ON rws.c = dp.c AND rws.i = dp.i + 1 JOIN stp ON stp.p = dp.st WHERE op = 'D' OR (fault NOT IN ('b', 'd') AND (op = 'R' OR stp.ini = rws.ini))) GROUP BY c, i, nx),
fct AS (SELECT c, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rws GROUP BY 1),
fin AS (SELECT c, min({'cost': cost + length(e) * 3, 'audit': audit || e, 'body': list_concat(body, ls)}) AS b FROM dp LEFT JOIN fct USING (c) JOIN (VALUES ('', '', []), ('s', 'II', ['user:', 'assistant:']), ('u', 'I', ['assistant:']), ('a', '', [])) z(st, e, ls) USING (st) WHERE i = coalesce(n, 0) GROUP BY 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(array_to_string(b.body, chr(10))) AS repaired_sha256
FROM cid JOIN fin USING (c) LEFT JOIN fct USING (c)"""


def oracle_sql() -> dict[str, str]:
    """SQL where a method has exact columns that SQL can give; tokenizers, models and byte windows have none."""
    return {"op9_tensored_minhash": NEAR_DUPLICATES, "op11_document_tree": RANKED, "op12_conversation_repair": REPAIRED}
