"""Versioned JSON documents in collections: current versions, ordered scans, equality lookups, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.jsonx import index_token, token_of
from mnemolake.sources.tables import latest


def current_documents(versions: DataFrame) -> DataFrame:
    """The greatest version of each (collection, id); of repeated versions the one updated last."""
    return latest(versions, ["collection", "id"], "version", "updated_at", "doc")


def scan(docs: DataFrame, collection: str, prefix: str | None = None, start: str | None = None, limit: int = 0, offset: int = 0, reverse: bool = False) -> DataFrame:
    """Documents of a collection in order of id. start is the least id, also in reverse; a limit of 0 is none."""
    out = docs.where(F.col("collection") == collection)
    if prefix:
        out = out.where(F.col("id").startswith(prefix))
    if start is not None:
        out = out.where(F.col("id") >= start)
    return _page(out, limit, offset, reverse)


def _page(out: DataFrame, limit: int, offset: int, reverse: bool) -> DataFrame:
    out = out.orderBy(F.desc("id") if reverse else F.asc("id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def count(docs: DataFrame) -> DataFrame:
    """(collection, documents) of each collection."""
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))


def find_by(docs: DataFrame, collection: str, field: str, value: object, limit: int = 0, offset: int = 0, reverse: bool = False) -> DataFrame:
    """Documents whose field equals a scalar, by type and spelling: 1 is neither "1" nor 1.0. Null, arrays and objects find nothing."""
    t = token_of(value)
    out = docs.where(F.col("collection") == collection)
    out = out.where(F.lit(False)) if t is None else out.where(index_token("doc", field) == t)
    return _page(out, limit, offset, reverse)


def find_many(docs: DataFrame, keys: DataFrame, collection: str, field: str) -> DataFrame:
    """Lookups of many values at once: keys (key string, a token as of index_token) joined with the field's tokens."""
    d = docs.where(F.col("collection") == collection).withColumn("key", index_token("doc", field)).where("key is not null")
    return keys.distinct().join(d, "key").select("key", "id", "version", "doc")


def unique_violations(docs: DataFrame, field: str) -> DataFrame:
    """(collection, token, documents): values of a field that several documents of a collection share."""
    t = docs.withColumn("token", index_token("doc", field)).where("token is not null")
    return t.groupBy("collection", "token").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
