"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import AWARDS, NULL_MARK


def read_tsv(spark: SparkSession, path: str, schema: StructType, null_mark: str | None = NULL_MARK, quote: str | None = None, partitions: int | None = None) -> DataFrame:
    """Tab-separated text with a header; ``.gz`` files decompress by suffix.

    ``null_mark`` reads as NULL (None keeps it as text); the default quote character
    is the reader's own.  A gzip file is one partition: give ``partitions`` when more
    than one action follows.
    """
    reader = spark.read.schema(schema).option("header", True).option("sep", "\t").option("emptyValue", "")
    reader = reader.option("nullValue", null_mark) if null_mark is not None else reader
    reader = reader.option("quote", quote) if quote is not None else reader
    df = reader.csv(path)
    return df.repartition(partitions) if partitions else df


def read_awards(spark: SparkSession, path: str, schema: StructType = AWARDS) -> DataFrame:
    """The award file: quoted fields, bad rows kept as far as they parse, empty fields NULL, the null mark left as text."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inventory(spark: SparkSession, path: str, schema: StructType, count_rows: bool = False, sample: int = 2) -> dict:
    """Size, header and first rows of a raw file, and its row count on request."""
    from .lake import Location

    df = read_tsv(spark, path, schema, null_mark=None)
    out = {"path": path, "size_bytes": Location(spark, path).size(), "header": df.columns, "sample": [r.asDict() for r in df.limit(sample).collect()]}
    return out | ({"rows": df.count()} if count_rows else {})
