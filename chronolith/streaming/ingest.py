"""New raw files to a bronze table as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schemas import NULL_MARK


def tsv_stream(spark: SparkSession, folder: str, schema: StructType, null_mark: str = NULL_MARK, files_per_trigger: int = 100) -> DataFrame:
    """Tab-separated files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("header", True).option("sep", "\t").option("emptyValue", "").option("nullValue", null_mark)
    return reader.option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append the prepared rows to a Parquet table, each file once, and stop when none is left."""
    return prepare(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
