"""Token-id shards with a minimal perfect hash index.

A shard is one binary value (a row of a Parquet table, so that any store Spark
writes to serves, and a lost task leaves nothing behind; ``export`` makes plain
files of them).  It holds::

    magic b"CLTS", version u32, item size u32, documents u64, keys u64, tokens u64,
    buckets u64, then
    document ids   i64 x documents   in payload order
    id is null     u8  x documents
    offsets        u64 x documents+1 token offsets in the payload
    displacements  u32 x buckets     of the minimal perfect hash
    fingerprints   u32 x keys        by slot
    ordinals       u32 x keys        by slot: the document's place
    payload        u16 or u32 x tokens

Keyed access hashes the id to a bucket, adds the bucket's displacement to get the
slot, compares the stored fingerprint, and reads the slot's ordinal and offsets:
constant time whatever the shard's size.  The stored document id is confirmed too.

Null text counts as empty: its only id is the end id.  A null document id sorts
first, is stored, and cannot be looked up; of rows that repeat an id within a shard
the first by text is the one the index knows, and enumeration gives all of them.
Texts of any length are encoded whole; extra columns do not matter; an empty table
makes no shard and no row.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import ChunkEncoder
from .common import cut, map_arrow, slices, text_of

HEAD = struct.Struct("<4sIIQQQQ")
MAGIC, VERSION = b"CLTS", 1
#: Tokens at which a shard is closed.
SHARD_TOKENS = 2_000_000
#: Keys to a bucket of the perfect hash, on average.
PER_BUCKET = 3


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mixer (the finaliser of splitmix64) of keys and a seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket and slots by key; keys are distinct uint64.

    Buckets are placed from the largest to the smallest; each takes the first seed
    that sends its keys to free, different slots.
    """
    n = len(keys)
    seeds = np.zeros(max(1, -(-n // PER_BUCKET)), np.uint32)
    slots, free = np.zeros(n, np.int64), np.ones(n, bool)
    if not n:
        return seeds, slots
    bucket = (mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
        members = order[edges[b] : edges[b + 1]]
        if not len(members):
            break
        first, tries = 1, 64
        while True:
            tried = np.arange(first, first + tries, dtype=np.uint64)
            at = (mix(keys[members][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            if len(members) > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                seeds[b], slots[members] = first + i, at[i]
                free[at[i]] = False
                break
            first, tries = first + tries, min(4 * tries, 16_384)
    return seeds, slots


def build_shard(ids: list[int | None], tokens: list[bytes], item: int) -> bytes:
    offsets = np.cumsum([0, *(len(t) // item for t in tokens)]).astype("<u8")
    null = np.array([i is None for i in ids], np.uint8)
    stored = np.array([0 if i is None else i for i in ids], "<i8")
    keyed = np.flatnonzero(null == 0)
    keys, first = np.unique(stored[keyed], return_index=True)
    ordinal = keyed[first]
    keys = keys.astype(np.int64).view(np.uint64)
    seeds, slots = perfect_hash(keys)
    prints, ordinals = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slots] = mix(keys, 0x5EED) >> np.uint64(32)
    ordinals[slots] = ordinal
    head = HEAD.pack(MAGIC, VERSION, item, len(ids), len(keys), int(offsets[-1]), len(seeds))
    return b"".join([head, stored.tobytes(), null.tobytes(), offsets.tobytes(), seeds.astype("<u4").tobytes(), prints.tobytes(), ordinals.tobytes(), *tokens])


class Shard:
    """Reads a shard from bytes or a memory-mapped file."""

    def __init__(self, raw) -> None:
        raw = memoryview(raw)
        magic, version, item, docs, keys, tokens, buckets = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.ids, self.null, self.offsets = take("<i8", docs), take("u1", docs), take("<u8", docs + 1)
        self.seeds, self.prints, self.ordinals = take("<u4", buckets), take("<u4", keys), take("<u4", keys)
        self.tokens = take(f"<u{item}", tokens)

    @classmethod
    def open(cls, path: str) -> Shard:
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Each id's ordinal, or -1; constant time for each."""
        out = np.full(len(ids), -1, np.int64)
        if len(self.prints) and len(ids):
            keys = np.asarray(ids, np.int64).view(np.uint64)
            seed = self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
            slot = (mix(keys, seed) % np.uint64(len(self.prints))).astype(np.int64)
            ordinal = self.ordinals[slot].astype(np.int64)
            same = (self.prints[slot] == (mix(keys, 0x5EED) >> np.uint64(32))) & (self.ids[ordinal] == ids)
            out[same] = ordinal[same]
        return out

    def get(self, ordinal: int) -> np.ndarray:
        return self.tokens[int(self.offsets[ordinal]) : int(self.offsets[ordinal + 1])]

    def lookup(self, doc_id: int) -> np.ndarray | None:
        ordinal = int(self.find(np.array([doc_id]))[0])
        return None if ordinal < 0 else self.get(ordinal)


def write(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and store ``docs`` in ascending id order; returns the shard table.

    Columns: part, seq (order of shards), first (tokens before the shard within
    its part), n_docs, n_tokens, shard.  Sampled splitters range-partition the
    rows by id, so one id is no more than its own rows, and each task sorts its
    range externally and closes a shard every SHARD_TOKENS tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer, spaced)
        end, item = encoder.pack([end_id]), 4 if encoder.wide else 2
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": [before], "n_docs": [len(ids)], "n_tokens": [held], "shard": pa.array([build_shard(ids, tokens, item)], pa.binary())})

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, packed in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                    ids.append(doc)
                    tokens.append(packed + end)
                    held += len(packed) // item + 1
                    if held >= SHARD_TOKENS:
                        yield close()
                        seq, before, held, ids, tokens = seq + 1, before + held, 0, [], []
        if ids:
            yield close()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return cut(map_arrow(ordered, run, "part int, seq int, first bigint, n_docs bigint, n_tokens bigint, shard binary"))


def starts(shards: DataFrame) -> DataFrame:
    """part and the tokens before it: a running sum over one row for each part."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read(shards: DataFrame) -> DataFrame:
    """Every stored document: doc_id, start, n_tokens, ids_crc32, by keyed access where its id is a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column("start").to_pylist(), batch.column("shard")):
                shard = Shard(raw.as_buffer())
                found = shard.find(shard.ids)
                at = np.arange(len(shard.ids))
                if ((found < 0) & (shard.null == 0)).any() or (shard.ids[np.maximum(found, 0)] != shard.ids)[shard.null == 0].any():
                    raise ValueError("the index misses a stored document")
                # a repeated id is found at its first row; the others are read in order
                again = (found != at) & (found >= 0)
                ordinal = np.where(again | (found < 0), at, found)
                crc = [zlib.crc32(shard.get(i).astype("<u4").tobytes()) for i in ordinal]
                offsets = shard.offsets.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, mask=shard.null.astype(bool)), pa.array(base + offsets[ordinal]), pa.array(offsets[ordinal + 1] - offsets[ordinal]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each part, of which there are no more than shuffle partitions
    placed = shards.join(F.broadcast(starts(shards)), "part").select((F.col("part_start") + F.col("first")).alias("start"), "shard")
    return map_arrow(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a plain file to a folder mounted on every executor; returns the paths.

    A file appears under its name only when whole, so a task can run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for part, seq, raw in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("shard").to_pylist()):
                names.append(os.path.join(folder, f"{part:06d}-{seq:06d}.clts"))
                with open(f"{names[-1]}.{os.getpid()}", "wb") as f:
                    f.write(raw)
                os.replace(f.name, names[-1])
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    return map_arrow(shards.select("part", "seq", "shard"), run, "path string")
