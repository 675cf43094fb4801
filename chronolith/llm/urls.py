"""URL filter over a sorted digest array.

Rules are keys of a host and a path prefix.  The array holds their 64-bit xxhash
digests in order, with offsets to the full keys.  Workers map the file into memory,
probe all candidate keys of a batch at once by binary search, and confirm the
stored key, so equal digests of different keys do no harm.

A rule fits its host and all subdomains if the path starts with the rule's path;
the longest fitting rule wins (by length of host and path; among equal lengths the
longer host).  Where none fits, a host label of BAD_LABELS blocks, else the url is
allowed.  Null urls and urls without ``://`` have an empty host and path, fit no
rule and are allowed.  Repeated rows, null ids among them, give repeated results, an
empty table none.  Urls of any length are taken whole.  Extra columns, also such as
``host`` or ``verdict``, do not matter.  Rules and labels are parameters: ``rules_of``
and ``labels_of`` read them from tables or files.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Host labels that block where no rule fits (fixed values): the driver's bad hosts, then common names of unwanted sites.
BAD_LABELS = (
    "adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm",
    "adserver", "adult", "ads", "betting", "bets", "casino", "clickbait", "doubleclick", "doorway", "escort", "gambling", "hentai", "keygen",
    "linkfarm", "malware", "payday-loans", "phishing", "pills", "poker", "popads", "porn", "porno", "roulette", "scam", "sex", "slots", "spam",
    "spyware", "torrent", "torrents", "tracker", "viagra", "warez", "webcams", "xxx",
)
#: Most rules of an array: with keys of up to 200 bytes it stays under 500 MB.
MOST_RULES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def key_of(kind: str, host: str, path: str) -> bytes:
    return f"{kind}\0{host}\0{path}".encode("utf-8", "surrogatepass")


class DigestArray:
    """The file: count, sorted digests, key offsets, values, then the keys."""

    @staticmethod
    def pack(entries: dict[bytes, int]) -> bytes:
        import xxhash

        if len(entries) > MOST_RULES:
            raise ValueError(f"{len(entries)} rules; an array holds {MOST_RULES} at most: match() joins larger lists")
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in entries.items())
        parts = [
            struct.pack("<q", len(rows)),
            np.array([r[0] for r in rows], "<u8").tobytes(),
            np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<i8").tobytes(),
            np.array([r[2] for r in rows], "<i4").tobytes(),
            *(r[1] for r in rows),
        ]
        return b"".join(parts)

    @staticmethod
    def build(entries: dict[bytes, int], path: str) -> None:
        with open(path, "wb") as f:
            f.write(DigestArray.pack(entries))

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<i8")
        self.values = raw[16 + 16 * n : 16 + 20 * n].view("<i4")
        self.keys = raw[16 + 20 * n :]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Each key's value, or -1."""
        import xxhash

        out = np.full(len(keys), -1, np.int32)
        if not keys or not len(self.digests):
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)
        for i in hits:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.keys[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    out[i] = self.values[j]
                    break
                j += 1
        return out


@functools.cache
def _folder() -> str:
    """A folder of this driver, from which its file server sends; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="digests-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def sent(spark: SparkSession, entries: dict[bytes, int]) -> str:
    """The name under which executors find the array; equal arrays are sent once."""
    raw = DigestArray.pack(entries)
    name = f"digests-{hashlib.sha256(raw).hexdigest()[:32]}.bin"
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        path = os.path.join(_folder(), name)
        with open(path, "wb") as f:
            f.write(raw)
        spark.sparkContext.addFile(path)
    return name


def rules_of(table: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """The rules of a table (verdict, host, path), for ``classify``; ValueError beyond MOST_RULES."""
    rows = table.select("verdict", "host", "path").where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules: match() joins larger lists")
    return tuple(sorted({tuple(r) for r in rows}))


def labels_of(lines: DataFrame, column: str = "value") -> tuple[str, ...]:
    """The host labels of a table, such as ``spark.read.text`` gives: one a row, ``#`` begins a comment."""
    label = F.lower(F.trim(F.regexp_replace(F.col(column), "#.*", "")))
    rows = lines.select(label.alias("label")).where("label <> ''").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} labels")
    return tuple(sorted(r.label for r in rows))


def classify(pages: DataFrame, rules=RULES, bad_labels=BAD_LABELS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The array file is made on the driver, its size bounded by MOST_RULES, and sent
    to each executor once; a new executor fetches it again.
    """
    entries = {key_of("rule", h, p): i for i, (_, h, p) in enumerate(rules)}
    entries |= {key_of("label", label, ""): i for i, label in enumerate(bad_labels)}
    name = sent(pages.sparkSession, entries)
    depth = max([h.count(".") + 1 for _, h, _ in rules], default=0)
    lengths = sorted({len(p) for _, _, p in rules})
    rank = sorted(range(len(rules)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), len(rules[i][1])))
    weight = {i: r for r, i in enumerate(rank)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys, owner, kind = [], [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                labels = host.split(".") if host else []
                for k in range(1, min(depth, len(labels)) + 1):
                    suffix = ".".join(labels[-k:])
                    for n in lengths:
                        if n <= len(path):
                            keys.append(key_of("rule", suffix, path[:n]))
                            owner.append(i)
                            kind.append(True)
                for label in set(labels):
                    keys.append(key_of("label", label, ""))
                    owner.append(i)
                    kind.append(False)
            best, bad = [-1] * len(hosts), [False] * len(hosts)
            values = array.probe(keys)
            for j in np.flatnonzero(values >= 0):
                i, v = owner[j], int(values[j])
                if not kind[j]:
                    bad[i] = True
                elif best[i] < 0 or weight[v] > weight[best[i]]:
                    best[i] = v
            rule = [rules[b][1] + rules[b][2] if b >= 0 else None for b in best]
            verdict = [rules[b][0] if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_column).cast("string")
    parts = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return map_arrow(parts, run, "page_id bigint, host string, path string, rule string, verdict string")


def match(pages: DataFrame, rules: DataFrame, depth: int, lengths: list[int], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The same rules from a table (verdict, host, path) of any size, by an equality join.

    ``depth`` is the most labels of a rule's host, ``lengths`` are the lengths of
    the rules' paths.  Returns page_id and the longest fitting rule of every row that
    has one.  Each distinct host and path is matched once, so a host of a third of
    all pages is a few keys; rows that repeat an id, null ids among them, stay apart.
    """
    url = F.col(url_column).cast("string")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    parts = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    place = parts.select("host", "path").distinct()
    keyed = place.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(F.transform(cuts, lambda n: F.left("path", n))).alias("p"))
    found = keyed.join(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    size = F.struct(F.length("h") + F.length("p"), F.length("h"))
    best = found.groupBy("host", "path").agg(F.max_by(F.concat("h", "p"), size).alias("rule"), F.max_by("verdict", size).alias("verdict"))
    return parts.join(best, ["host", "path"]).select("page_id", "rule", "verdict")
