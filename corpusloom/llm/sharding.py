"""Proportional stratified interleaving into shards, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import distributed_rank
from corpusloom.session import materialize

#: Rows that one task numbers.
BUCKET_ROWS = 20_000
#: Bits of the shuffling key.
KEY_BITS = 60


def stratified_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = 42) -> DataFrame:
    """Deal rows to shards so that each has the same mixture and, up to one, as many rows.

    Rows of each stratum are ranked in an order drawn from ``seed`` and the id,
    and all rows sorted by fractional rank ``(rank + 0.5) / rows of the stratum``;
    shard s takes the s-th of equal cuts of that order.  Returns id, ``size``
    (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law`` (``rows``), ``shard``,
    ``slot`` (gapless from 0 in a shard) and ``grown_shard`` (null under this law).

    A null text has size 1 and the checksum of an empty one; null strata form one
    stratum and null ids one order key; ties and repeated rows are ordered by size
    and checksum and may swap places only if equal.  An empty table gives an empty
    result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = materialize(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("")).alias("stratum"),
            key.alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bits = max(8, (total // BUCKET_ROWS).bit_length() + 1)
    tie = ["key", "id", "size", "crc"]
    strata = rows.groupBy("stratum").agg(F.count("*").alias("of_stratum"))
    ranked = distributed_rank(rows, ["stratum"], F.shiftright("key", KEY_BITS - bits), tie).join(strata, "stratum")
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("of_stratum"))
    placed = distributed_rank(ranked, [], F.floor(F.col("fraction") * (1 << bits)).cast("long"), ["fraction", *tie], "place")
    count = max(total, 1)
    shard = F.floor(F.expr(f"place * {shards} div {count}"))
    start = F.expr(f"(shard * {count} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
