"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bahikhata.llm import classifier, html, licenses, media, middle, mixing, outliers, packing, sharding, simhash, sketches, token_files, turns
from bahikhata.llm.common import table
from bahikhata.llm.tokens import public


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.digest(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op5_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op11_version_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.digest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": op1_page_text,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_licenses": op4_licenses,
    "op5_png_media": op5_png_media,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_classifier": op9_classifier,
    "op10_sharding": op10_sharding,
    "op11_version_sketches": op11_version_sketches,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE: dict[str, str] = {
    # The leaf of a document is its first prefix whose bucket doesn't split (fits, or holds one document).
    "op10_sharding": f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
b AS (SELECT doc_id, n_bytes, array_to_string(list_transform(range(1, 16), lambda i: right(bin(strpos('0123456789abcdef', h[i]) - 1 + 16), 4)), '') AS bits FROM d),
p AS (SELECT doc_id, n_bytes, g.depth, left(bits, g.depth) AS shard FROM b, (SELECT CAST(unnest(range(0, 41)) AS INT) AS depth) g),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, shard) AS t, count(*) OVER (PARTITION BY depth, shard) AS n FROM p)
SELECT doc_id, n_bytes, shard, depth, CAST(t AS BIGINT) AS shard_bytes FROM s WHERE t <= {sharding.LIMIT} OR n = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
