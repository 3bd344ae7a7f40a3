"""Owners, access, and deletion everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owned_documents(docs: DataFrame, bases: DataFrame, owner: int, deleted: bool = False) -> DataFrame:
    """The documents of one owner's knowledge bases, of active ones unless asked; failed ones are left out."""
    own = bases.where((F.col("owner") == owner) & (F.lit(deleted) | (F.col("status") == "active"))).select("kb_id")
    return docs.where("status <> 'failed'").join(own, "kb_id", "left_semi")


def access_check(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """``request_id, decision``: missing, denied, deleted or ok."""
    met = requests.join(bases, "kb_id", "left")
    decision = F.when(F.col("owner").isNull(), "missing").when(F.col("owner") != F.col("user_id"), "denied").when(F.col("status") == "deleted", "deleted").otherwise("ok")
    return met.select("request_id", decision.alias("decision"))


def delete_document(tables: dict[str, DataFrame], gone: DataFrame, below: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``gone``; relations lose both directions.

    ``below`` names for tables without a ``doc_id`` the table above and the column they
    share, such as ``{"postings": ("chunks", "chunk_id")}``: rows go with the last row above them.
    """
    out = {}
    for name, df in tables.items():
        for col in ("doc_id", "related_doc_id"):
            if col in df.columns:
                df = df.join(gone.select(F.col("doc_id").alias(col)), col, "left_anti")
        out[name] = df
    for name, (above, key) in (below or {}).items():
        out[name] = out[name].join(out[above].select(key).distinct(), key, "left_semi")
    return out


def replace_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Relations after those of the documents in ``new`` are replaced."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def clear_base(tables: dict[str, DataFrame], gone: DataFrame, key: str = "kb_id") -> dict[str, DataFrame]:
    """Every table without the rows of the knowledge bases in ``gone``."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def soft_delete(bases: DataFrame, gone: DataFrame) -> DataFrame:
    """All bases; those in ``gone`` have the status ``deleted``."""
    marked = gone.select("kb_id").distinct().withColumn("__gone", F.lit(True))
    status = F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))
    return bases.join(marked, "kb_id", "left").withColumn("status", status).select(*bases.columns)


def sessions(messages: DataFrame) -> DataFrame:
    """``conv_id, messages, last_turn, title``: one row a chat, named after its first question."""
    asked = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 80)), F.when(F.col("role") == "user", F.struct("turn", "text")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), asked.alias("title"))


def session_page(chats: DataFrame, page: int, size: int, updated: str = "last_turn") -> DataFrame:
    """One page of chats, the last updated first, with their ``place`` from 1."""
    rows = chats.orderBy(F.desc(updated), "conv_id").offset(page * size).limit(size)  # a page
    place = F.row_number().over(Window.orderBy(F.desc(updated), "conv_id")).cast("long")
    return rows.withColumn("place", place + page * size)


def chat_messages(messages: DataFrame, citations: str = "citations", at: str = "turn") -> DataFrame:
    """``conv_id, place, role, text, doc_ids, titles``: the messages of each chat by time, their citations parsed.

    Citations are a JSON list of objects with ``doc_id`` and ``title``; null, empty and
    broken ones are none.
    """
    parsed = F.from_json(F.col(citations), "array<struct<doc_id: string, title: string>>")
    some = F.coalesce(F.filter(parsed, lambda c: c.isNotNull()), F.array().cast("array<struct<doc_id: string, title: string>>"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(at, "role", "text")).cast("long")
    return messages.withColumn("__c", some).select("conv_id", place.alias("place"), "role", "text", F.col("__c.doc_id").alias("doc_ids"), F.col("__c.title").alias("titles"))
