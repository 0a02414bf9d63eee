"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fim, fingerprint, kneser_ney, langid, licenses, minhash, pii, sentencepiece_np, suffixes, templates, toxicity, tries
from tidemark.llm.store import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_np.encode(read(spark, sf_dir, "documents"))


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.repeated_bytes(read(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(read(spark, sf_dir, "pages"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=3, share=0.5)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in the directory of its source and language."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(read(spark, sf_dir, "documents"), seed=1, unit="char", rate=90, spm=20))
    digest = [F.sha2(c, 256).alias(f"{d}_sha256") for c, d in (("output", "output"), ("restored", "restored"))]
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digest)


ORACLES["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS prefix, '<S>' || substring(t, b + 1) AS suffix, '<M>' || substring(t, a + 1, b - a) AS middle FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(read(spark, sf_dir, "conversations"), family=20, heads_most=4)


ORACLES["op13_conversation_trie"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS place,
  {'role': role, 'text': text} AS said FROM t),
c AS (SELECT conv_id, list(said ORDER BY place) AS own,
  list_reduce([ord(x) FOR x IN string_split(conv_id::VARCHAR, '')],
    lambda r, b: xor(list_reduce([xor(r, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), r >> 8), 4294967295) AS crc
  FROM o GROUP BY conv_id),
h AS (SELECT conv_id, own, (4294967295 - crc) % 4 AS h, conv_id - conv_id % 20 AS base FROM c),
r AS (SELECT x.conv_id, coalesce(b.own[1:x.h], []) || x.own[x.h + 1:] AS said FROM h x LEFT JOIN h b ON b.conv_id = x.base),
p AS (SELECT conv_id, d AS depth, said[1:d] AS path, len(said) = d AS final, said[d].text AS last FROM r, range(0, len(said) + 1) AS g(d)),
n AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256,
  (count(*) - 1) * coalesce(len(regexp_extract_all(min(last), '[^\x20\x09-\x0D]+')), 0) AS saves FROM p GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:a] AS path, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, range(0, depth + 1) AS g(a) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = m.path[1:m.depth - 1]
"""
