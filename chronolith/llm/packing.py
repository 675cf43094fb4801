"""Packing along a space-filling curve.

A document's token ids are hashed into a vector, projected to three dimensions and
given the Hilbert key of its cell, so documents with like vocabularies get near
keys and copies get equal ones.  Rows are range-sorted by key and laid end to end;
the stream is cut every ``length`` tokens.  Only the very last sequence can be
short: it is cut at powers of two, so no sequence needs padding.

Ranges are split by key, then document id, so any number of copies under one key
spreads over many tasks.  Ranges and tasks follow from the bytes of the ids.  Null
text counts as empty: the document is its end id.  Rows that repeat an id are packed
each; among equal keys and ids the order follows the ids' checksum.  Texts of any
length are encoded whole, extra columns do not matter, an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunked import ChunkEncoder
from .common import cut, map_arrow, partitions, slices, text_of

LENGTH = 2048
BINS, DIMS, BITS = 256, 3, 10
#: Sampled rows for each range; ranges for each shuffle partition.
PER_RANGE, RANGES = 32, 4
#: Bytes of ids that a task should get, and the most ranges, beyond which they grow instead; a range is never held whole.
TASK_BYTES, MOST_RANGES = 64 << 20, 20_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of rows of ``dims`` coordinates below ``2**bits`` (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[:, i] & q) > 0
            swap = (x[:, 0] ^ x[:, i]) & (q - 1)
            x[:, 0] ^= np.where(on, q - 1, swap)
            x[:, i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(tokens: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed vector."""
    plane = np.random.default_rng(7).standard_normal((BINS, DIMS))
    plane -= plane.mean(axis=0)
    counts = np.zeros((len(tokens), BINS))
    for i, ids in enumerate(tokens):
        hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        counts[i] = np.bincount(hashed, minlength=BINS)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    at = counts @ plane / np.where(norm > 0, norm, 1)
    cells = np.clip((1 / (1 + np.exp(-2 * at)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, hkey, n, tie (checksum) and the ids as little-endian binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer, spaced=False)
        end, kind = encoder.pack([end_id]), "<u4" if encoder.wide else "<u2"
        for whole in batches:
            for batch in slices(whole, "text"):
                packed = [p + end for p in encoder.encode(batch.column("text"))]
                ids = [np.frombuffer(p, kind) for p in packed]
                keys = curve_keys(ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(list(map(len, ids)), pa.int64()), pa.array(map(zlib.crc32, packed), pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "hkey", "n", "tie", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return cut(map_arrow(rows, run, "doc_id bigint, hkey bigint, n bigint, tie bigint, ids binary"))


def splitters(rows: DataFrame, keys: list[str], ranges: int) -> list[tuple]:
    """Sorted splitters from a sample of at most about ``ranges * PER_RANGE`` rows of the key columns."""
    total = rows.count()
    share = min(1.0, ranges * PER_RANGE / max(total, 1))
    sample = sorted(map(tuple, rows.select(*keys).sample(share, 11).limit(2 * ranges * PER_RANGE).collect()))
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def range_of(keys: list[str], cuts: list[tuple]) -> Column:
    """The place of a row's keys among the splitters, by two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    at = F.struct(*[F.col(k).alias(k) for k in keys])
    literal = lambda c: F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, c)])
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.array(*[literal(b[0]) for b in blocks]), lambda c: c <= at))
    fine = F.array(*[F.array(*map(literal, b)) for b in blocks])
    inner = F.size(F.filter(F.get(fine, coarse - 1), lambda c: c <= at))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inner)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (binary), ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenized once and written; the ranges' token totals come from
    the narrow columns; the ids then cross one shuffle to their range, where each
    task sorts its ranges and cuts.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, end_id, id_column, text_column)
    # null ids sort first, as the smallest id would
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keys = ["hkey", "at"]
    wide = 4 if _wide(tokenizer) else 2
    size = (rows.agg(F.sum("n")).first()[0] or 0) * wide
    tasks = max(partitions(spark), -(-size // TASK_BYTES))
    cuts = splitters(rows, keys, max(RANGES * partitions(spark), min(RANGES * tasks, MOST_RANGES)))
    placed = rows.withColumn("bucket", range_of(keys, cuts))
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = totals.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for b, doc, n, before, total, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "before", "total", "ids"))):
                if b != bucket:
                    bucket, at = b, before
                ids = np.frombuffer(raw, f"<u{wide}")
                for start, size, sequence, offset in pieces(at, n, total, length):
                    cutout = ids[start : start + size].astype("<u4").tobytes()
                    out.append((doc, start, size, ids[start : start + size].tobytes(), zlib.crc32(cutout), n, sequence, offset))
                at += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    there = placed.join(F.broadcast(cut(before)), "bucket") if len(cuts) < 100_000 else placed.join(before, "bucket")
    # at the session's own number of partitions adaptive execution may merge small ones
    dealt = there.repartition(F.col("bucket")) if tasks == partitions(spark) else there.repartition(tasks, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", "hkey", "at", "tie")
    out = dealt.select("bucket", "doc_id", "n", "before", "total", "ids")
    return map_arrow(out, run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _wide(tokenizer: str) -> bool:
    return ChunkEncoder(tokenizer, False).wide


def pieces(at: int, n: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, size, sequence, offset there) of a document at stream position ``at``.

    The stream's first ``total // length`` sequences are full; the rest is cut into
    sequences of the powers of two that sum to it, the largest first.
    """
    full = total // length * length
    done = 0
    while done < n:
        here = at + done
        if here < full:
            sequence, begin, size = here // length, here // length * length, length
        else:
            sequence, begin, left = full // length, full, total - full
            size = 1 << (left.bit_length() - 1)
            while here >= begin + size:
                begin, left, sequence = begin + size, left - size, sequence + 1
                size = 1 << (left.bit_length() - 1)
        took = min(n - done, begin + size - here)
        yield done, took, sequence, here - begin
        done += took
