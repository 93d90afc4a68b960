"""Queries of the training-data operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import chat_format, conversation_repair, embedding_dedup, fingerprints, html_extract, language_id, merkle, mixing, packing, secret_scan, sentencepiece_codec, simhash_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_and_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat_format.format_conversations(rows.unionByName(probe))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_read(spark, sf_dir, "conversations"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=merkle.tampered_documents(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    found = [op1_simhash_dedup, op2_embedding_dedup, op3_sentencepiece, op4_secret_scan, op5_chat_format, op6_language_id, op7_warc, op8_html_extract, op9_fingerprints, op10_packing, op11_conversation_repair, op12_source_mix, op13_merkle_manifest]
    return {f.__name__: f for f in found}


OP7_SQL = """WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""


OP12_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(('0x' || left(md5(concat_ws(':', 'mix', COALESCE(CAST(doc_id AS VARCHAR), '-'), md5(COALESCE(text, '')))), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, sum(3 * source_size) OVER up AS cap, sum(w) OVER up AS heavy, sum(source_size) OVER () AS total, sum(w) OVER () AS every FROM w
  WINDOW up AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT COALESCE(sum(3 * source_size), 0) AS capped, COALESCE(sum(w), 0) AS gone FROM o WHERE 3 * source_size * (every - heavy + w) <= (total - cap + 3 * source_size) * w),
t AS (SELECT source, source_size, CASE WHEN every = gone THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), CAST(total - capped AS DOUBLE) / CAST(every - gone AS DOUBLE) * w) END AS target FROM o, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""

_LEAF = "sha256(" + " || ".join(f"COALESCE(CAST(strlen(CAST({{{c}}} AS VARCHAR)) AS VARCHAR) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_PLAIN = {c: c for c in ("doc_id", "source", "lang", "n_chars", "text")}
# CRC-32 of a text's bytes, a table step a byte
_CRC = """CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), LAMBDA a, b: xor(a >> 8, steps[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT)"""
OP13_SQL = f"""WITH RECURSIVE steps AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR k IN range(8)]), LAMBDA a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)),
crc AS (SELECT documents.*, {_CRC} AS crc FROM documents, steps),
leaf AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id, leaf) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_LEAF.format(**_PLAIN)} AS leaf, CASE WHEN crc % 7 = 0 THEN {_LEAF.format(**_PLAIN | {"n_chars": "(n_chars + 1)"})} ELSE {_LEAF.format(**_PLAIN)} END AS changed FROM crc)),
tree(lang, level, i, n, d) AS (SELECT lang, 0, i, n, leaf FROM leaf UNION ALL SELECT lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
sub AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, i, n, d) AS (SELECT 0, i, n, subroot FROM sub UNION ALL SELECT level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
path(id, lang, stage, level, i, n, fold, sibs) AS (SELECT id, lang, 0, 0, i, n, changed, '' FROM leaf
  UNION ALL SELECT p.id, p.lang, CASE WHEN p.n = 1 THEN p.stage + 1 ELSE p.stage END, CASE WHEN p.n = 1 THEN 0 ELSE p.level + 1 END, CASE WHEN p.n = 1 THEN s.i ELSE p.i // 2 END, CASE WHEN p.n = 1 THEN s.n ELSE (p.n + 1) // 2 END,
    CASE WHEN p.n = 1 THEN p.fold WHEN x.d IS NULL THEN sha256(p.fold) WHEN p.i % 2 = 0 THEN sha256(p.fold || x.d) ELSE sha256(x.d || p.fold) END, p.sibs || COALESCE(x.d, '')
  FROM path p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN (SELECT 0 AS stage, lang, level, i, d FROM tree UNION ALL SELECT 1, NULL, level, i, d FROM top) x ON p.n > 1 AND x.stage = p.stage AND (p.stage = 1 OR x.lang IS NOT DISTINCT FROM p.lang) AND x.level = p.level AND x.i = xor(p.i, 1)
  WHERE p.stage < 2 AND NOT (p.stage = 1 AND p.n = 1)),
ends AS (SELECT id, fold, sibs FROM path WHERE stage = 1 AND n = 1),
root AS (SELECT d FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(sibs) AS proof_sha256, fold AS folded_root, fold = root.d AS verified FROM leaf JOIN ends USING (id) JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, root"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op12_source_mix": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
