"""The registered queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import pieces, quality, secrets
from quarry.llm.common import Scratch, table
from quarry.llm.exact_dedup import exact_groups
from quarry.llm.line_dedup import without_boilerplate
from quarry.llm.neighbours import nearest
from quarry.llm.packing import pack
from quarry.llm.sharding import shard_by_bytes
from quarry.llm.simhash import near_duplicates
from quarry.llm.token_files import read_index, write_files


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.summaries(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model, threshold=0.7)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, factor=1.0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("ids")
    write_files(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=1)
    return read_index(spark, path)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe(), end_id=1, capacity=4096)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "documents"), sites=8).select("doc_id", "n_removed", "text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_secret_scans": op3_secret_scans,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_vantage_point_search": op5_vantage_point_search,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_range_coded_ids": op7_range_coded_ids,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_line_dedup": op9_line_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": EXACT_DEDUP_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op10_sharding": SHARDING_SQL}


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS nth
  FROM documents
), keyed AS (
  SELECT doc_id, source, line, nth, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines
), spread AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 8
), judged AS (
  SELECT k.doc_id, k.line, k.nth, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN spread s ON k.key = s.key
)
SELECT doc_id, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '') AS text
FROM judged GROUP BY doc_id
"""

#: The checksum is folded over the bytes of a text, by a table that is made from the polynomial.
SHARDING_SQL = """
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS c
    FROM range(256) r(i)
  )
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda pair: ('0x' || pair)::UBIGINT) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda x, y: xor(x >> 8, step[xor(x & 255, y)::BIGINT + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32,
         coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM d, crc
), cut AS (
  SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
