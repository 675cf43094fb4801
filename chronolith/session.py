"""SparkSession factory."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import SparkSession


def usable_default_fs(uri: str | None) -> bool:
    """Whether a Hadoop default file system names a scheme and, except for file, an authority."""
    parts = urlparse(uri or "")
    return parts.scheme == "file" or bool(parts.scheme and parts.netloc)


def build_session(app: str = "chronolith", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None, max_result_size: str | None = None, local_dir: str | None = None, default_fs: str | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; only what is given is set.

    On a cluster the master, memory and shuffle parallelism come from spark-submit.
    ``local_dir`` must be a plain local path, ``default_fs`` must name an authority.
    """
    if local_dir and "://" in local_dir:
        raise ValueError("spark.local.dir must be a local path")
    if default_fs and not usable_default_fs(default_fs):
        raise ValueError(f"default file system has no authority: {default_fs}")
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.driver.memory": driver_memory,
        "spark.driver.maxResultSize": max_result_size,
        "spark.local.dir": local_dir,
        "spark.hadoop.fs.defaultFS": default_fs,
        "spark.checkpoint.dir": checkpoint_dir,
    } | conf
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    for key, value in wanted.items():
        builder = builder.config(key, str(value)) if value is not None else builder
    return builder.getOrCreate()
