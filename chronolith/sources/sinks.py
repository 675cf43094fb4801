"""Write, read again, validate, publish, report."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import check_output_path
from ..plans.explain import physical_plan
from .lake import REPOSITORY, Location


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def reread_count(df: DataFrame, path: str, expected: int) -> int:
    """Rows of the written table; RuntimeError if they are not ``expected``."""
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise RuntimeError(f"{path} holds {found} rows, {expected} were expected")
    return found


def _previous(path: str) -> str:
    return f"{path.rstrip('/')}__previous"


def restore(spark: SparkSession, path: str) -> bool:
    """Put the former table back where a publication was cut short between its two renames."""
    target, fs = Location(spark, path)._fs()
    kept = Location(spark, _previous(path))._fs()[0]
    return not fs.exists(target) and fs.exists(kept) and fs.rename(kept, target)


def publish(df: DataFrame, path: str, validate: Callable[[DataFrame], object] | None = None, root: str | None = None) -> dict:
    """Write to a staging path, compare the counts, validate what was written, then move it into place.

    A table that fails validation is never published, and with ``root`` none outside
    the data root.  The count of ``df`` is a run of its own, over the columns that its
    joins need only.  The former table is kept until the new one stands.
    """
    spark, staging = df.sparkSession, f"{path.rstrip('/')}__staging"
    if root is not None:
        uri = lambda p: Location(spark, p).resolve()
        check_output_path(uri(path), uri(root), uri(REPOSITORY)).raise_if_failed()
    began = time.time()
    write_parquet(df, staging)
    written = spark.read.parquet(staging)
    rows = reread_count(df, staging, df.count())
    result = validate(written) if validate else None
    if result is not None:
        result.raise_if_failed()
    restore(spark, path)
    target, fs = Location(spark, path)._fs()
    kept = Location(spark, _previous(path))._fs()[0]
    fs.delete(kept, True)
    if fs.exists(target) and not fs.rename(target, kept):
        raise RuntimeError(f"could not set the former {path} aside")
    if not fs.rename(Location(spark, staging)._fs()[0], target):
        restore(spark, path)
        raise RuntimeError(f"could not publish {path}")
    fs.delete(kept, True)
    again = spark.read.parquet(path)
    return {
        "output_path": path,
        "rows": rows,
        "output_size_bytes": Location(spark, path).size(),
        "output_schema": again.schema.jsonValue(),
        "partitions": again.rdd.getNumPartitions(),
        "duration_seconds": round(time.time() - began, 3),
        "validation": result.as_dict() if result is not None else None,
    }


def dump_plan(df: DataFrame, place: Location) -> str:
    place.write_text(text := physical_plan(df))
    return text


def write_metrics(place: Location, job: str, **metrics: object) -> dict:
    """One JSON document for a job, with the time and the Spark version."""
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    document = {"job": job, "completed_at_utc": now, "spark_version": place.spark.version} | metrics
    place.write_text(json.dumps(document, indent=2, default=str))
    return document
