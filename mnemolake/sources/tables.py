"""Explicit schemas of the model's tables, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_FILTERS = "array<struct<field:string,value:string>>"

#: Schemas of the tables as delivered; no reader infers one.
SCHEMAS = {
    "event_log": "seq bigint, agent_id string, stream_id string, kind_tag string, ts_ms bigint, causation bigint, correlation string, payload string, arrived_at timestamp_ntz",
    "projection_runs": "projection string, run_no int, started_at timestamp_ntz, read_until timestamp_ntz, finished_at timestamp_ntz, status string",
    "index_docs": f"id string, name string, body string, tags string, vector array<float>, filters {_FILTERS}, indexed_at timestamp_ntz",
    "collection_docs": "collection string, id string, version bigint, doc string, updated_at timestamp_ntz",
    "hybrid_queries": f"query_id bigint, query_text string, vector array<float>, k int, filters {_FILTERS}",
    "size_limits": "limit_id string, table_name string, field_name string, unit string, max_size int, overlap int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, docket_no string, version_no int, decided_on timestamp_ntz, headnote string",
    "subject_areas": "subject string, scope_note string",
    "subject_labels": "doc_id bigint, subject string, annotator string, labelled_at timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

EVENT_KINDS = ("Fact", "StateTransition", "MemoryInvalidate", "ToolCall", "ConsentGranted", "ConsentRevoked", "IntentLogged", "LearningProposal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in sf_dir, with its fixed schema where one is known."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(T.StructType.fromDDL(SCHEMAS[name]) if hasattr(T.StructType, "fromDDL") else SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the row with the greatest values of the order columns, null first.

    Rows that tie are taken to be equal; one of them stays. Rows with a null key stay, as one key.
    A rank of one plans a partial group limit, so all but one row of a key and task stay behind before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def current_events(log: DataFrame) -> DataFrame:
    """The current record of each seq: its row with the greatest arrived_at."""
    return latest(log, ["seq"], "arrived_at")


def current_docs(docs: DataFrame) -> DataFrame:
    """The current document of each id: its row with the greatest indexed_at."""
    return latest(docs, ["id"], "indexed_at")
