"""Exact deduplication by a content sort, by DataFrame functions only.

Texts are equal when they agree after white space of ``[\\x20\\x09-\\x0D]`` is deleted.
Sampled splitters over the normalised content (its first characters, then the
document id) deal rows to ranges; each range is sorted externally by the whole
normalised text, equals come to lie together, and each row is compared in full with
its neighbour.  Since splitters include the id, a text that a third of all rows
share spreads over many ranges; the runs that a text has in several ranges are then
joined through the text's SHA-256, one row for each run.

Of equal texts the row with the most code points of original text stays, then the
smallest id (null first), then one row of those that repeat it.  Null text counts
as empty.  Extra columns pass through untouched.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, few, partitions, text_of
from .packing import RANGES, range_of, splitters

#: Characters of normalised content in a splitter.
PREFIX = 40


def normalised(text):
    return F.translate(text, SPACES, "")


def content_sort(docs: DataFrame, wide: bool, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows with their run: id, bucket, run, first (of its run), len, sha, and ``row`` (all columns) if ``wide``."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if wide else [id_column])]).alias("row")
    rows = docs.select(row, F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("id", F.lit(-(1 << 63))), "prefix": F.left(normalised(F.left("text", F.lit(4 * PREFIX))), F.lit(PREFIX))})
    keys = ["prefix", "at"]
    cuts = splitters(rows, keys, RANGES * partitions(docs.sparkSession))
    rows = rows.withColumn("bucket", range_of(keys, cuts))
    if wide:  # the text crosses once, inside its row
        dealt = rows.select("row", "id", "at", "bucket").repartition("bucket")
        dealt = dealt.withColumn("text", text_of(f"row.`{text_column}`"))
        dealt = dealt.select("row", "id", "at", "bucket", normalised(F.col("text")).alias("norm"), F.length("text").alias("len"))
    else:
        dealt = rows.select("row", "id", "at", "bucket", normalised(F.col("text")).alias("norm"), F.length("text").alias("len")).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("norm", F.desc("len"), "at")
    first = F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(True))
    marked = dealt.withColumn("first", first)
    run = F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("run", run)
    return cut(out.select(*(["row"] if wide else []), "id", "at", "bucket", "run", "first", "len", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")))


def decide(ordered: DataFrame) -> DataFrame:
    """bucket, run, keep_id, group_size and best (whether the run's first row stays)."""
    head = F.when(F.col("first"), F.struct((-F.col("len")).alias("len"), "at", "bucket", "run", "id"))
    runs = ordered.groupBy("bucket", "run", "sha").agg(F.count(F.lit(1)).alias("n"), F.max(head).alias("head"))
    texts = runs.groupBy("sha").agg(F.sum("n").alias("group_size"), F.min("head").alias("kept"))
    joined = runs.join(texts, "sha")
    best = (F.col("kept.bucket") == F.col("bucket")) & (F.col("kept.run") == F.col("run"))
    return joined.select("bucket", "run", F.col("kept.id").alias("keep_id"), "group_size", best.alias("best"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    ordered = content_sort(docs, False, id_column, text_column)
    verdicts = ordered.join(decide(ordered), ["bucket", "run"])
    return verdicts.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("first") & F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    ordered = content_sort(docs, True, id_column, text_column)
    # written narrow: if its files are under Spark's threshold the whole rows stay where they are, else both sides are sorted
    lost = cut(few(decide(ordered).where(~F.col("best")).select("bucket", "run"), ordered.count()))
    return ordered.where("first").join(lost, ["bucket", "run"], "left_anti").select("row.*")
