"""Rows told apart by id and content, and a table without some of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.llm.bloom import Bloom

#: Keys of rows that may be broadcast: 16 bytes each.
MAX_KEYS = 1_000_000


def row_id(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long").alias("_id")


def row_tag(docs: DataFrame, *content: str) -> Column:
    """A number that tells rows of equal ids apart by these columns (null is not the empty string)."""
    parts = [p for c in content for p in (docs[f"`{c}`"], docs[f"`{c}`"].isNull())]
    return F.xxhash64(*parts).alias("_tag")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_tag"] == right["_tag"])


def _keyed(docs: DataFrame, content: tuple[str, ...]) -> DataFrame:
    return docs.select(row_id(docs), row_tag(docs, *content), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def with_keys(docs: DataFrame, keys: DataFrame, *content: str) -> DataFrame:
    """_id, _tag, _row of the rows whose key is in ``keys`` (_id, _tag; distinct, written)."""
    rows = _keyed(docs, content)
    if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        return rows.join(few := F.broadcast(keys), _same(rows, few), "left_semi")
    near = rows.where(Bloom(keys, "_id", "_tag").may_hold(F.col("_id"), F.col("_tag")))
    return near.join(keys, _same(near, keys), "left_semi")


def without_keys(docs: DataFrame, keys: DataFrame, *content: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``keys`` (_id, _tag; distinct, written).

    Few keys are broadcast; beyond that only rows that a Bloom filter can't rule out are shuffled.
    """
    rows = _keyed(docs, content)
    if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        return rows.join(few := F.broadcast(keys), _same(rows, few), "left_anti").select("_row.*")
    may = rows.withColumn("_may", Bloom(keys, "_id", "_tag").may_hold(F.col("_id"), F.col("_tag")))
    near = may.where("_may")
    return may.where("NOT _may").select("_row.*").union(near.join(keys, _same(near, keys), "left_anti").select("_row.*"))
