"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one integer whose bit ``i`` says that rule ``i`` failed.  A policy is a versioned
mask: applying one, comparing two, or measuring what a rule contributes is integer
arithmetic on the ledger and never touches a text again.

Null and empty texts have no words and fail ``too_short``.  Repeated rows give
repeated results, an empty table none.  Texts of any length are measured whole.  Extra
columns of any name travel inside the struct ``row`` and never meet the measurements.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, map_arrow, slices, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: (name, condition of failure over the measurements); a rule's place is its bit, so new rules go at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
    ("too_many_repeats", "100 * n_repeat_words > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_windows"]
#: Policies by version.
POLICIES = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["long_words"],
    3: reduce(or_, BIT.values()),
}
LATEST = 2


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words that the text holds twice or more.

    Exact: equal windows get equal numbers by ranking halves, then pairs of halves.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    span = 1
    while span < width:
        left, right = codes[: len(codes) - span], codes[span:]
        top = int(codes.max()) + 1
        if top >= 1 << 31:
            codes = np.unique(codes, return_inverse=True)[1]
            continue
        codes = left * top + right
        span *= 2
        if span == width // 2 and len(distinct := np.unique(codes)) == len(codes):
            return 0
        if span == width // 2:
            codes = np.searchsorted(distinct, codes)
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = [measure_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["row", *MEASURES])


def failed_bits() -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]).cast("long")


def ledger(docs: DataFrame, columns: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """``row`` (a struct of the named columns), the measurements and ``failed_bits``."""
    columns = docs.columns if columns is None else columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_of(text_column).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    measured = map_arrow(packed, _measured, f"row {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return measured.withColumn("failed_bits", failed_bits())


def store(docs: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """The ledger of the named columns, written to the shared folder and read again: policies and ablations start there."""
    return cut(ledger(docs, columns, text_column))


def passes(version: int = LATEST) -> Column:
    """Whether a ledger row passes the policy of that version."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def keep(docs: DataFrame, version: int = LATEST, text_column: str = "text") -> DataFrame:
    """The documents that pass, with their own columns; the text crosses to Python once."""
    return ledger(docs, text_column=text_column).where(passes(version)).select("row.*")


def ablation(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents failing it, and failing it alone.

    One aggregation over the ledger's bits, combined in the map tasks.
    """
    mask = POLICIES[version]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    named = [(name, bit) for name, bit in BIT.items() if bit & mask]
    sums = [F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"f{bit}") for _, bit in named]
    sums += [F.count_if(bits == bit).alias(f"a{bit}") for _, bit in named]
    one = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(bits != 0).alias("n_rejected"), *sums)
    out = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"a{b}").alias("n_failed_alone")) for n, b in named]))
    return one.select("n_docs", "n_rejected", out.alias("r")).select(F.lit(version).alias("policy"), "n_docs", "n_rejected", "r.*")
