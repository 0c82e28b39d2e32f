"""Stores with the surface that agent frameworks expect: a vector store of texts, and a store of items in namespaces."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import functions as F

from mnemolake.operators.predicates import in_namespace, texts_at, value_matches
from mnemolake.store import MemoryStore

_MOST_LEVELS = 16


@dataclass(frozen=True)
class Item:
    namespace: tuple[str, ...]
    key: str
    value: dict
    created_at: int
    updated_at: int
    score: float | None = None


class NamespaceStore:
    """Items by namespace and key in a collection; search by text over all strings of a value, or over some of its paths."""

    COLLECTION = "items"

    def __init__(self, store: MemoryStore, fields: list[str] | None = None):
        self.store, self.fields = store, fields or ["$"]

    @staticmethod
    def _id(namespace: tuple[str, ...], key: str) -> str:
        return json.dumps([*namespace, key], ensure_ascii=False)

    @staticmethod
    def _item(doc: dict, score: float | None = None) -> Item:
        return Item(tuple(doc["namespace"]), doc["key"], doc["value"], doc["created_at"], doc["updated_at"], score)

    def put(self, namespace: tuple[str, ...], key: str, value: dict | None, index: bool | list[str] = True) -> None:
        """Keep an item; None deletes it. With index=False it is kept but not found by text."""
        self.put_many([(namespace, key, value, index)])

    def put_many(self, items: list[tuple]) -> None:
        """Items (namespace, key, value, index) as one version of the documents and one of the index; of repeated keys the last counts."""
        if any(not 0 < len(ns) <= _MOST_LEVELS for ns, *_ in items):
            raise ValueError(f"a namespace has 1 to {_MOST_LEVELS} levels")
        last = {self._id(ns, key): (ns, key, value, index) for ns, key, value, index in items}
        now = self.store.clock.now_ms()
        known = self.store.documents.frame().where((F.col("collection") == self.COLLECTION) & F.col("id").isin(list(last)))
        born = {r["id"]: int(r["at"]) for r in known.select("id", F.get_json_object("doc", "$.created_at").alias("at")).collect()}
        rows, found = [], {}
        for id_, (ns, key, value, index) in last.items():
            if value is None:
                rows.append({"op": "delete", "collection": self.COLLECTION, "id": id_})
                found[id_] = None
                continue
            doc = {"namespace": list(ns), "key": key, "value": value, "created_at": born.get(id_, now), "updated_at": now}
            rows.append({"op": "put", "collection": self.COLLECTION, "id": id_, "doc": doc})
            paths = [] if index is False else self.fields if index is True else index
            levels = [(f"ns{i}", level) for i, level in enumerate(ns)]
            found[id_] = {"id": id_, "body": "\n".join(texts_at(value, paths)), "filters": levels} if index is not False else None
        self.store.documents.batch(rows)
        self.store.index_batch([d for d in found.values() if d], [i for i, d in found.items() if d is None])

    def get(self, namespace: tuple[str, ...], key: str) -> Item | None:
        have = self.store.documents.get(self.COLLECTION, self._id(namespace, key))
        return self._item(have[1]) if have else None

    def delete(self, namespace: tuple[str, ...], key: str) -> None:
        self.put(namespace, key, None)

    def _frame(self):
        d = self.store.documents.frame().where(F.col("collection") == self.COLLECTION)
        return d.select("id", "doc", F.from_json(F.get_json_object("doc", "$.namespace"), "array<string>").alias("ns"), F.get_json_object("doc", "$.value").alias("value"))

    def search(self, prefix: tuple[str, ...], query: str | None = None, filter: dict | None = None, limit: int = 10, offset: int = 0) -> list[Item]:
        """Items under a prefix whose levels match whole. Conditions on values apply before the best are chosen."""
        rows = self._frame().where(in_namespace("ns", list(prefix)))
        if filter:
            rows = rows.where(value_matches("value", filter))
        if not query:
            return [self._item(json.loads(r["doc"])) for r in rows.orderBy("id").offset(offset).limit(limit).collect()]
        named = [(f"ns{i}", level) for i, level in enumerate(prefix) if level != "*"]
        hits = self.store.query_hybrid(query, k=max(1, limit + offset), filters=named, allow=rows.select("id"))
        ranked = self.store.spark.createDataFrame([(h["id"], i, h["score"]) for i, h in enumerate(hits)], "id string, place int, score double")
        found = rows.join(ranked, "id").orderBy("place").offset(offset).limit(limit).collect()
        return [self._item(json.loads(r["doc"]), r["score"]) for r in found]

    def list_namespaces(self, prefix: tuple[str, ...] = (), suffix: tuple[str, ...] = (), max_depth: int | None = None, limit: int = 100, offset: int = 0) -> list[tuple[str, ...]]:
        ns = self._frame().where(in_namespace("ns", list(prefix)) & in_namespace("ns", list(suffix), suffix=True))
        ns = ns.select((F.slice("ns", 1, max_depth) if max_depth else F.col("ns")).alias("ns")).distinct().orderBy("ns").offset(offset).limit(limit)
        return [tuple(r["ns"]) for r in ns.collect()]

    def batch(self, ops: Iterable[tuple]) -> list:
        """Operations ("put" | "put_many" | "get" | "search" | "list_namespaces" | "delete", arguments...) in order."""
        return [getattr(self, name)(*args) for name, *args in ops]


class TextStore:
    """Texts with metadata, found by meaning and words."""

    def __init__(self, store: MemoryStore):
        self.store = store

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        ids = ids or [str(uuid.uuid4()) for _ in texts]
        metas = metadatas or [{} for _ in texts]
        if not len(texts) == len(ids) == len(metas):
            raise ValueError("texts, metadatas and ids differ in number")
        self.store.upsert_batch([{"id": i, "body": t, "filters": m} for i, t, m in zip(ids, texts, metas)])
        self.store.documents.batch([{"op": "put", "collection": "texts", "id": i, "doc": {"text": t, "metadata": m}} for i, t, m in zip(ids, texts, metas)])
        return ids

    @classmethod
    def from_texts(cls, store: MemoryStore, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> TextStore:
        out = cls(store)
        out.add_texts(texts, metadatas, ids)
        return out

    def delete(self, ids: list[str]) -> None:
        self.store.index_batch([], ids)
        self.store.documents.batch([{"op": "delete", "collection": "texts", "id": i} for i in ids])

    def get_by_ids(self, ids: list[str]) -> list[dict]:
        wanted = self.store.spark.createDataFrame([(i,) for i in ids], "id string")
        rows = {r["id"]: json.loads(r["doc"]) for r in self.store.documents.frame().where("collection = 'texts'").join(F.broadcast(wanted), "id").collect()}
        return [{"id": i} | rows[i] for i in ids if i in rows]

    def similarity_search(self, query: str, k: int = 4, filter: dict | None = None) -> list[tuple[dict, float]]:
        return self._documents(self.store.query_hybrid(query, k=k, filters=filter))

    def similarity_search_by_vector(self, vector: list[float], k: int = 4, filter: dict | None = None) -> list[tuple[dict, float]]:
        return self._documents(self.store.query_hybrid(vector=vector, k=k, filters=filter))

    def vectors_by_ids(self, ids: list[str]) -> dict[str, list[float] | None]:
        rows = self.store.index.frame().where(F.col("id").isin(ids)).select("id", "vector").collect()
        return {r["id"]: r["vector"] for r in rows}

    def _documents(self, hits: list[dict]) -> list[tuple[dict, float]]:
        docs = {d["id"]: d for d in self.get_by_ids([h["id"] for h in hits])}
        return [(docs[h["id"]], h["score"]) for h in hits if h["id"] in docs]
