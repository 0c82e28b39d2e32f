"""Queries of the text and vector problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.encode import count_tokens, encode_corpus
from mnemolake.llm.knn import nearest, pairs_of
from mnemolake.llm.langid import document_language, fit_sample, identify, segments
from mnemolake.llm.pack import pack
from mnemolake.llm.runs import collapse_runs, tool_calls
from mnemolake.llm.sql import ORACLES  # noqa: F401
from mnemolake.llm.split import split_oversized
from mnemolake.llm.subjects import composition, subjects
from mnemolake.session import materialize
from mnemolake.sources.tables import current_docs, current_events, table

#: Numbers of a vector of the index.
VECTOR_DIM = 32


def _limit(spark: SparkSession, sf_dir: str, limit_id: str) -> tuple[int, int]:
    r = table(spark, sf_dir, "size_limits").where(F.col("limit_id") == limit_id).first()
    return r["max_size"], r["overlap"]


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _limit(spark, sf_dir, "idx_body")
    docs = current_docs(table(spark, sf_dir, "index_docs").select("id", "body", "indexed_at"))
    return split_oversized(docs, ["id"], "body", limit, overlap, units=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select("id", F.col("unit_no").alias("para_no"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("unit_no = 0").drop("unit_no")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = current_docs(table(spark, sf_dir, "index_docs").select("id", "vector", "indexed_at"))
    return nearest(docs, VECTOR_DIM, k=5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(_neighbours(spark, sf_dir))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "event_log").where("kind_tag = 'ToolCall' and seq is not null").select("agent_id", "stream_id", "seq", "ts_ms", "kind_tag", "payload", "arrived_at")
    return tool_calls(current_events(log))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_calls(spark, sf_dir)).where("n >= 3").select("first_seq", "last_seq")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_calls(spark, sf_dir))


def p4_near_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_calls(spark, sf_dir), least=0.8, gap_ms=3_600_000)


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = current_docs(table(spark, sf_dir, "index_docs").select("id", "name", "body", "filters", "indexed_at"))
    segs = materialize(segments(docs), "segments")
    return identify(segs, fit_sample(segs))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _languages(spark, sf_dir)
    return found.where("lang is not null and not array_contains(named, lang)").select("id", "seg_no", "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("id", "seg_no", "lang", "confidence")


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_language(_languages(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumnRenamed("doc_id", "item_id")
    sizes = materialize(sizes, "sizes")
    out = None
    for r in table(spark, sf_dir, "size_limits").where("unit = 'tokens' and table_name = 'documents'").orderBy("limit_id").collect():
        one = pack(sizes, r["max_size"]).withColumn("limit_id", F.lit(r["limit_id"]))
        out = one if out is None else out.unionByName(one)
    return out.select("limit_id", F.col("item_id").alias("doc_id"), "piece_no", "start", "tokens", "container_id")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(_subjects(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_neighbours, p4_found, p4_runs, p4_near_runs, p5_found, p5_segments, p5_documents, p8_ids, p9_containers, p10_found, p10_composition)}
