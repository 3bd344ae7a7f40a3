"""One query per operator, over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, html_text, jaccard, langid, merkle, packing, pii, quality_model, quality_rules, sharding, simhash, token_counts, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = pii.listing(spans, pii.KINDS[:4])
    return found.select("doc_id", *counts[:4], F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.listing(spans).alias("spans"), *counts[4:])


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.learn_blocks(pages))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs.where(_remainder(5) != 0))
    return langid.identify_language(docs, model).withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.learn_quality(docs.where(_remainder(4) != 2), _table(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, model).withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_main_text,
        op3_decontamination,
        op4_sharding,
        op5_quality_rules,
        op6_language_id,
        op7_packing,
        op8_token_counts,
        op9_simhash,
        op10_quality_model,
        op11_merkle,
        op12_whitening,
        op13_jaccard,
    )
}


#: CRC-32 by a table that follows from its polynomial; the rest is ranks over the seeded order.
_SHARDS_SQL = """WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
r AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key, coalesce('=' || source, '') AS stratum,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x : CAST('0x' || x AS BIGINT))),
        lambda c, x : xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size, crc) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id, size, crc) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard,
  CAST(place - ((place * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


def oracles() -> dict[str, str]:
    """The SQL twins, by query name."""
    return {"op4_sharding": _SHARDS_SQL}
