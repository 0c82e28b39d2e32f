"""The semantic index over a versioned table: a fixed vector space, upserts by id, deletes by filter, hybrid queries."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.operators import retrieval
from mnemolake.operators.predicates import filters_in, has_filters
from mnemolake.session import materialize
from mnemolake.sources.versioned import VersionedTable


class IndexError_(ValueError):
    """An error with a code: INVALID_VECTOR, VECTOR_SPACE_MISMATCH, INDEX_DEGRADED or EMBEDDER_UNAVAILABLE."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def error_code(error: BaseException) -> str | None:
    text = str(error)
    return next((c for c in ("INVALID_VECTOR", "VECTOR_SPACE_MISMATCH", "INDEX_DEGRADED", "EMBEDDER_UNAVAILABLE") if f"{c}:" in text), None)


class SemanticIndex:
    SCHEMA = "id string, name string, body string, tags string, vector array<float>, filters array<struct<field:string,value:string>>"

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, space_id: str | None = None):
        if dimension is not None and not 1 <= dimension <= 65_536:
            raise IndexError_("INVALID_VECTOR", "the dimension must be from 1 to 65536")
        if dimension is not None and not (space_id or "").strip():
            raise IndexError_("INVALID_VECTOR", "a vector space needs an id")
        self.spark = spark
        self.table = VersionedTable(spark, f"{path}/index", self.SCHEMA)
        self.words = VersionedTable(spark, f"{path}/postings", "id string, field string, term string, tf bigint, len int, pos array<int>")
        space = VersionedTable(spark, f"{path}/space", "dimension int, space_id string, metric string")
        have = space.read().first()
        if have and dimension is not None and (have["dimension"], have["space_id"]) != (dimension, space_id):
            raise IndexError_("VECTOR_SPACE_MISMATCH", f"the index holds {have['space_id']} of {have['dimension']} dimensions")
        if not have and dimension is not None:
            space.commit(spark.createDataFrame([(dimension, space_id, "cosine")], space.schema))
        self.dimension = have["dimension"] if have else dimension

    def check_vector(self, vector: list[float] | None) -> None:
        if vector is None:
            return
        if self.dimension is None:
            raise IndexError_("INVALID_VECTOR", "this index has no vectors")
        if len(vector) != self.dimension or not all(math.isfinite(x) for x in vector) or not any(vector):
            raise IndexError_("INVALID_VECTOR", f"a vector has {self.dimension} finite numbers, not all zero")

    def frame(self) -> DataFrame:
        return self.table.read()

    def upsert(self, docs: list[dict], gone: list[str] | None = None) -> None:
        """Replace documents by id, and delete those gone; of repeated ids the last counts. A document without a vector loses the one it had."""
        last: dict[str, tuple] = {}
        for d in docs:
            self.check_vector(d.get("vector"))
            v = d.get("vector")
            last[d["id"]] = (d["id"], d.get("name"), d.get("body"), d.get("tags"), None if v is None else [float(x) for x in v], [{"field": k, "value": x} for k, x in filters_in(d.get("filters"))])
        self._replace(last, [i for i in gone or [] if i not in last])

    def _replace(self, last: dict[str, tuple], gone: list[str]) -> None:
        """One version: these documents instead of those with their ids, and without the ids that are gone."""
        ids = [*last, *gone]
        if ids:
            base = self.table.version()
            old = self.table.positions(base).where(F.col("id").isin(ids)).select(F.col("_file").alias("file"), F.col("_row").alias("row_index"))
            self.table.commit(self.spark.createDataFrame(list(last.values()), self.SCHEMA) if last else None, old if base else None, base=base)

    def upsert_frame(self, docs: DataFrame, order: list[str]) -> None:
        """Bulk load: of repeated ids the last in order counts; a vector that isn't valid fails the job."""
        w = Window.partitionBy("id").orderBy(*[F.col(c).desc() for c in order])
        one = docs.withColumn("_r", F.row_number().over(w)).where("_r = 1")
        bad = F.col("vector").isNotNull() & ~retrieval.valid_vector("vector", self.dimension or 0)
        one = one.withColumn("vector", F.when(bad, F.raise_error(F.concat(F.lit("INVALID_VECTOR: "), F.col("id")))).otherwise(F.col("vector")))
        self.table.upsert(one.select(*self.table.schema.fieldNames()), ["id"])

    def _drop(self, condition) -> int:
        base = self.table.version()
        gone = self.table.positions(base).where(condition).select(F.col("_file").alias("file"), F.col("_row").alias("row_index"))
        return self.table.commit(deleted=gone, base=base) if base else 0

    def delete(self, id: str) -> None:
        self._drop(F.col("id") == id)

    def delete_by_filter(self, field: str, value: object) -> None:
        self._drop(has_filters(filters_in([(field, value)])))

    def clear(self) -> None:
        m = self.table.manifest()
        if m["data"]:
            self.table.commit(drop=m["data"], base=m["version"])

    def compact(self) -> None:
        """Write the live rows as new files; the old ones leave the manifest, as do their deletion vectors."""
        self.table.compact()

    def postings(self) -> DataFrame:
        """The kept postings, brought up to the index's version: only documents that changed since are read and cut into words.

        New postings, the deletion of old ones and the version that they stand for enter the table in one manifest.
        """
        from mnemolake.functions.analyzer import stemmed_terms, stop_words

        base, now = self.words.manifest(), self.table.version()
        since = base["processed"].get("index", 0)
        if since < now:
            changed = materialize(self.table.diff(since, now), "index-changes")
            fresh = retrieval.positional_postings(changed.where("change = '+'"), terms=stemmed_terms(stop_words())).orderBy("term")
            gone = None
            if base["data"]:
                old = self.words.positions(base["version"]).join(changed.select("id").distinct(), "id", "left_semi")
                gone = old.select(F.col("_file").alias("file"), F.col("_row").alias("row_index"))
            self.words.commit(fresh, gone, processed={"index": now}, base=base["version"])
        return self.words.read()

    def stats(self) -> dict[str, int]:
        r = self.frame().agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("vector").isNotNull()).alias("vectors")).first()
        return r.asDict() | {"dimension": self.dimension or 0}

    def query(self, text: str | None = None, vector: list[float] | None = None, k: int = 10, filters: object = None, fusion: dict | None = None, boosts: dict | None = None, terms=None, allow: DataFrame | None = None) -> list[dict]:
        """The k best documents; allow, a table of ids, leaves out all others before the best are chosen."""
        if k < 1:
            raise ValueError("k must be positive")
        fusion = fusion or {"kind": "rrf"}
        if fusion.get("kind") != "rrf":
            raise ValueError(f"unknown fusion kind: {fusion.get('kind')}")
        self.check_vector(vector)
        q = self.spark.createDataFrame(
            [(0, text, None if vector is None else [float(x) for x in vector], k, [{"field": a, "value": b} for a, b in filters_in(filters)])],
            "query_id bigint, query_text string, vector array<float>, k int, filters array<struct<field:string,value:string>>",
        )
        from mnemolake.functions.analyzer import analyze, stemmed_terms, stop_words

        stops = stop_words()
        read = (lambda w: [w.lower()]) if terms else (lambda w: analyze(w, stops))
        kept = self.postings() if terms is None and (text or "").strip() else None
        hits = retrieval.hybrid(self.frame(), q, self.dimension or 0, boosts, terms or stemmed_terms(stops), fusion.get("k", retrieval.RRF_K), read, allow, kept)
        return [{c: r[c] for c in ("id", "score", "text_score", "vector_score")} for r in hits.orderBy("rank").collect()]  # k rows


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)
