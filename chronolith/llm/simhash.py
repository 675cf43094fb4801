"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint has a bit set if over half of its shingles' hashes have it.
Two fingerprints link at no more than three differing bits.  Cut into two segments,
one of them differs by at most one bit, so each distinct fingerprint is indexed, for
each segment, under the segment itself and under each of its 32 one-wildcard
variants.  Equal keys meet in a join (the two values of the wildcard bit are its two
sides, so a pair meets once a segment), and the whole fingerprints are compared
there.  The join works on distinct fingerprints: copies are one row, no pair of
copies is made, and no link between different fingerprints is lost.

A bucket in which a segment value of over CROWD fingerprints stands is divided: two
fingerprints there differ by at most three bits in the other segment, so in one of
its halves by at most one.  One side is keyed by both halves, the other by both and
all their one-bit neighbours.  A fingerprint thus meets at most CROWD others in a
plain bucket, and ``2**16`` in a divided one, whatever the number of documents.

Links become components by alternating large and small stars over the link table.

Words end at ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased; a shingle is three words,
repeats included, joined by spaces; fewer words are one shingle; none give
fingerprint zero, which links like any other.  Null text counts as empty.  Rows that
repeat an id are rows of one document.  A null id takes part; a component of null
ids only has a null id.  An empty table gives none.  Texts of any length are hashed
whole; extra columns pass ``keep`` as they are and do not matter elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, map_arrow, slices, text_of

WORDS, SEED, DISTANCE, SEGMENT = 3, 42, 3, 32
#: Fingerprints with one segment value from which its buckets are divided.
CROWD = 2048
#: Hashes whose bits are counted at once.
COUNT_AT_ONCE = 1 << 16


def shingles(text: str, width: int = WORDS) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: str, width: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    parts = shingles(text, width)
    if not parts:
        return 0
    hashes = np.array([xxh64_intdigest(p, SEED) for p in parts], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_AT_ONCE):
        counts += np.unpackbits(hashes[i : i + COUNT_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (a signed long with the fingerprint's bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return cut(map_arrow(rows, run, "doc_id bigint, fp bigint"))


def _variants(fps: DataFrame, side: int) -> DataFrame:
    """key and fp: each segment as it is, and with each bit of value ``side`` as the wildcard."""
    parts = []
    for s in range(64 // SEGMENT):
        part = F.shiftrightunsigned("fp", s * SEGMENT).bitwiseAND((1 << SEGMENT) - 1)
        tag = lambda at, s=s: F.lit((s << 6 | at) << SEGMENT)
        parts.append(F.array(part.bitwiseOR(tag(SEGMENT))))
        wild = F.array(*[F.when(part.bitwiseAND(F.lit(1 << b)) == F.lit(side << b), part.bitwiseAND(F.lit(~(1 << b))).bitwiseOR(tag(b))) for b in range(SEGMENT)])
        parts.append(F.array_compact(wild))
    return fps.select("fp", F.explode(F.concat(*parts)).alias("key"))


def _crowded(fps: DataFrame, crowd: int) -> DataFrame:
    """The keys of buckets in which a segment value of over ``crowd`` fingerprints stands."""
    plain = [F.shiftrightunsigned("fp", s * SEGMENT).bitwiseAND((1 << SEGMENT) - 1).bitwiseOR(F.lit((s << 6 | SEGMENT) << SEGMENT)) for s in range(64 // SEGMENT)]
    full = fps.select(F.explode(F.array(*plain)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    bare = F.col("key").bitwiseAND(F.lit(~(63 << SEGMENT)))
    wild = [bare.bitwiseAND(F.lit(~(1 << b))).bitwiseOR(F.lit(b << SEGMENT)) for b in range(SEGMENT)]
    return cut(full.select(F.explode(F.array("key", *wild)).alias("key")).distinct())


def _divided(rows: DataFrame, neighbours: bool) -> DataFrame:
    """fp and key: the key followed by each half of the other segment, and by the half's one-bit neighbours if asked."""
    half = SEGMENT // 2
    other = F.when(F.shiftright("key", SEGMENT + 6) == 0, F.shiftrightunsigned("fp", SEGMENT)).otherwise(F.col("fp"))
    flips = [0, *(1 << b for b in range(half))] if neighbours else [0]
    parts = [F.shiftrightunsigned(other, j * half).bitwiseAND((1 << half) - 1).bitwiseOR(F.lit(j << half)) for j in range(2)]
    deep = [F.shiftleft("key", half + 1).bitwiseOR(part.bitwiseXOR(F.lit(flip))) for part in parts for flip in flips]
    return rows.select("fp", F.explode(F.array(*deep)).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Pairs (u, v) of different fingerprints at ``distance`` bits or fewer; ``fps`` are distinct.

    A pair can come once for each segment, and in divided buckets for each half.
    Two segments serve distances up to three.
    """
    if distance > 3:
        raise ValueError("two segments with one wildcard find distances of three at most")
    # no hint: Spark broadcasts the crowded keys if their files are small, and else sorts by the key of the join that follows
    crowded = _crowded(fps, crowd)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance

    def met(sides: list[DataFrame], tag: int) -> DataFrame:
        a = sides[0].select("key", F.col("fp").alias("u"))
        b = sides[1].select(F.col("key").alias("other"), F.col("fp").alias("v"))
        exact = F.shiftright("key", tag).bitwiseAND(63) == SEGMENT
        return a.hint("merge").join(b, (F.col("key") == F.col("other")) & near & (~exact | (F.col("u") < F.col("v")))).select("u", "v")

    plain = [_variants(fps, side).join(crowded, "key", "left_anti") for side in (0, 1)]
    full = [_divided(_variants(fps, side).join(crowded, "key", "left_semi"), bool(side)) for side in (0, 1)]
    return met(plain, SEGMENT).union(met(full, SEGMENT + SEGMENT // 2 + 1))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's pairs as stars: as many components, fewer rows."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        rows = [(x, r) for x in list(root) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(pairs: DataFrame, nodes: int | None = None) -> DataFrame:
    """node and root (its component's smallest node) of every node in a pair.

    ``nodes``, how many there are at most, sizes the files of the first round and decides no result.

    Rounds of a large star (every node's larger neighbours go to its smallest) and a
    small star (its smaller ones too), as long as the pairs change: about the
    logarithm of the longest chain.  Each round's pairs are written, so lineage
    stays short.
    """
    smaller = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = smaller(map_arrow(pairs, _forest, "u bigint, v bigint"))
    edges, seen = cut(stars if nodes is None else few(stars, nodes)), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = smaller(large)
        low = own.groupBy("u").agg(F.min("v").alias("m"))
        small = own.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        edges = cut(few(smaller(small), state[0]))


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and component_id (the smallest id reachable) of every distinct fingerprint."""
    fps = cut(few(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), prints.count()))
    roots = components(links(fps.select("fp"), distance), fps.count())
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = fingerprints(docs, id_column, text_column)
    joined = prints.join(classes(prints, distance), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep(docs: DataFrame, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document of each component with the smallest id, with its own columns; rows with a null id stay."""
    prints = fingerprints(docs, id_column, text_column)
    found = prints.join(classes(prints, distance), "fp")
    lost = cut(few(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("lost_id")), prints.count()))
    # no hint: Spark broadcasts the ids if their files are under its threshold, and joins by sorting if not
    return docs.join(lost, docs[id_column] == lost["lost_id"], "left_anti")
