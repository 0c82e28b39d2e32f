"""Mutable JSON documents in collections over a versioned table: optimistic versions, equality indexes, atomic batches."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.jsonx import index_token, token_of
from mnemolake.operators import documents as ops
from mnemolake.sources.versioned import VersionedTable


class VersionMismatch(ValueError):
    """The document isn't at the version that was expected."""


class UniqueViolation(ValueError):
    """Another document has this value in a unique field."""


class Documents:
    SCHEMA = "collection string, id string, version bigint, doc string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, f"{path}/documents", self.SCHEMA)
        self.catalog = VersionedTable(spark, f"{path}/indexes", "collection string, field string, is_unique boolean")
        self._lock = threading.RLock()

    def frame(self) -> DataFrame:
        return self.table.read()

    def indexes(self) -> dict[tuple[str, str], bool]:
        return {(r["collection"], r["field"]): r["is_unique"] for r in self.catalog.read().collect()}  # one row an index

    def get(self, collection: str, id: str) -> tuple[int, object] | None:
        r = self.frame().where((F.col("collection") == collection) & (F.col("id") == id)).first()
        return (r["version"], json.loads(r["doc"])) if r else None

    def put(self, collection: str, id: str, doc: object, expected: int | None = None) -> int:
        return self.batch([{"op": "put", "collection": collection, "id": id, "doc": doc, "expected": expected}])[0]

    def delete(self, collection: str, id: str) -> bool:
        return self.batch([{"op": "delete", "collection": collection, "id": id}])[0]

    def batch(self, ops_: list[dict]) -> list:
        """All or nothing, each operation seeing the ones before; the results are new versions and whether something was deleted."""
        with self._lock:
            keys = sorted({(o["collection"], o["id"]) for o in ops_})
            if not keys:
                return []
            wanted = self.spark.createDataFrame(keys, "collection string, id string")
            base = self.table.version()
            # positions of the touched rows only; a batch names every one of them
            touched = self.table.positions(base).join(F.broadcast(wanted), ["collection", "id"], "left_semi").collect()
            state = {(r["collection"], r["id"]): (r["version"], r["doc"]) for r in touched}
            results: list = []
            for o in ops_:
                key = (o["collection"], o["id"])
                have = state.get(key)
                if o["op"] == "delete":
                    results.append(have is not None)
                    state.pop(key, None)
                    continue
                expected = o.get("expected")
                if expected is not None and expected != (have[0] if have else 0):
                    raise VersionMismatch(f"{key} is at version {have[0] if have else 0}, not {expected}")
                state[key] = ((have[0] if have else 0) + 1, json.dumps(o["doc"], separators=(",", ":"), ensure_ascii=False))
                results.append(state[key][0])
            rows = [(*k, *v) for k, v in state.items()]
            new = self.spark.createDataFrame(rows, self.SCHEMA)
            self._check_unique(new, wanted)
            gone = [(r["_file"], r["_row"]) for r in touched]
            self.table.commit(new if rows else None, self.spark.createDataFrame(gone, "file string, row_index bigint") if gone else None, base=base)
            return results

    def _check_unique(self, new: DataFrame, touched: DataFrame) -> None:
        for (collection, field), unique in self.indexes().items():
            if not unique:
                continue
            rest = self.frame().join(F.broadcast(touched), ["collection", "id"], "left_anti")
            t = rest.unionByName(new).where(F.col("collection") == collection).withColumn("t", index_token("doc", field))
            mine = new.where(F.col("collection") == collection).select(index_token("doc", field).alias("t")).where("t is not null").distinct()
            if not t.join(F.broadcast(mine), "t", "left_semi").groupBy("t").count().where("count > 1").isEmpty():
                raise UniqueViolation(f"{collection}.{field}")

    def create_index(self, collection: str, field: str, unique: bool = False) -> None:
        """Again with the same uniqueness it does nothing, with another it fails; a unique index over repeated values isn't made."""
        with self._lock:
            have = self.indexes().get((collection, field))
            if have is not None:
                if have != unique:
                    raise ValueError(f"index {collection}.{field} exists with another uniqueness")
                return
            if unique and not ops.unique_violations(self.frame().where(F.col("collection") == collection), field).isEmpty():
                raise UniqueViolation(f"{collection}.{field}")
            self.catalog.commit(self.spark.createDataFrame([(collection, field, unique)], self.catalog.schema))

    def scan(self, collection: str, **page) -> DataFrame:
        return ops.scan(self.frame(), collection, **page)

    def count(self, collection: str) -> int:
        return self.frame().where(F.col("collection") == collection).count()

    def find_by(self, collection: str, field: str, value: object, **page) -> DataFrame:
        if (collection, field) not in self.indexes():
            raise KeyError(f"no index on {collection}.{field}")
        return ops.find_by(self.frame(), collection, field, value, **page) if token_of(value) is not None else self.frame().limit(0)
