"""Vectors and texts in plain files: little-endian 32-bit rows, one text a line."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_f32(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(position, vector) of a file of dim 32-bit floats a row. The file is split between tasks at row bounds; positions follow its order."""
    rows = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex()
    return spark.createDataFrame(rows.map(lambda r: (r[1], list(struct.unpack(f"<{dim}f", r[0])))), "position bigint, vector array<float>")


def write_f32(df: DataFrame, vector: str, order: str, path: str) -> int:
    """One file of the vectors in an order, row by row through an iterator; for export of bounded samples. Gives the number of rows."""
    n = 0
    with open(path, "wb") as f:
        for r in df.select(vector, order).orderBy(order).toLocalIterator():
            f.write(struct.pack(f"<{len(r[0])}f", *r[0]))
            n += 1
    return n


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, text) of each line of a text file, in its order."""
    return spark.createDataFrame(spark.sparkContext.textFile(path).zipWithIndex().map(lambda r: (r[1], r[0])), "position bigint, text string").select("position", F.col("text"))
