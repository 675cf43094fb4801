"""Byte-pair encoding and decoding, written here.

A word is a doubly linked list of symbols.  A priority queue holds every adjacent
pair that merges, by rank and place; an entry whose symbols have changed since is
stale and skipped.  Words repeat, so a worker keeps the ids of those it has met, up
to a bound.  Decoding looks up each id's string and concatenates them as the
library does (a space between, as the vocabulary file names no decoder).

The normaliser and the splitting pattern are those of the vocabulary file
word_bpe_49k.json: NFC, white space to one space, lower case by character, then the
pattern; bytes map to printable characters.  Strings of special tokens in a text
are those tokens, as in the library's default.

Null text counts as empty: no ids, and the decoded text is empty.  Repeated rows give
repeated results, an empty table none.  Texts of any length are encoded whole, word by
word; of merges of equal rank the leftmost goes first.  Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_of

#: Words and chunks that a worker remembers.
MOST_WORDS, MOST_CHUNKS = 500_000, 300_000
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable character of each byte: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in visible else chr(256 + next(spare)) for b in range(256)]


class Memory(dict):
    """Results of a function by argument, worked out when first looked up."""

    def __init__(self, work) -> None:
        self.work = work

    def __missing__(self, key: str):
        out = self[key] = self.work(key)
        return out


class WordBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = self.vocabulary
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges) if a in ids and b in ids}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocabulary | self.special).items()}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.words, self.chunks = Memory(self.word), Memory(self.chunk)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge a word's symbols by rank, leftmost first among equal ranks."""
        merges, n = self.merges, len(symbols)
        after, ahead = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                ahead[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(queue, (found[0], i, made, symbols[k], found[1]))
            if (h := ahead[i]) >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(queue, (found[0], h, symbols[h], made, found[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece of the splitting pattern."""
        raw = word.encode()
        letters = list(word) if len(raw) == len(word) and word.isalpha() else [self.letters[b] for b in raw]
        letters[-1] += self.suffix
        ids = self.vocabulary
        return tuple(self.merge([ids[x] for x in letters if x in ids]))

    def plain(self, text: str) -> Iterator[int]:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        for word in PATTERN.findall(text):
            yield from self.words[word]

    def ids(self, text: str) -> list[int]:
        """Ids of any text."""
        if self.splitter is None or "<|" not in text:
            return list(self.plain(text))
        out: list[int] = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(self.plain(part))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids of a run without spaces, and its decoded text, each piece followed by a space."""
        mark = chunk[-1:] if chunk[-1:] in (",", ".") else ""
        core = chunk[: len(chunk) - len(mark)]
        if core.isascii() and core.isalpha():  # one piece, or one and a mark: the pattern need not run
            ids = [*self.words[core.lower()], *(self.words[mark] if mark else ())]
        else:
            ids = self.ids(chunk)
        return array("I", ids).tobytes(), (self.decode(ids) + " ").encode() if ids else b""

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids as little-endian unsigned 32-bit integers, and its decoded text.

        Spaces and newlines end words and are dropped, so chunks between them are
        encoded one by one, each distinct one once.
        """
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks.clear()
        found = list(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]


def round_trip(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; with ``outputs`` the ids and the decoded text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                done = [bpe.encode_bytes(t) for t in batch.column("text").to_pylist()]
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in done], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in done], pa.string()),
                ]
                if outputs:
                    columns += [pa.array([array("I", i).tolist() for i, _ in done], pa.list_(pa.int64())), pa.array([d.decode() for _, d in done], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if outputs else [])]
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if outputs else "")
    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")), run, schema)
