"""Whole-text encoding with the tokenizers library, each distinct chunk once.

The library spends most of its time merging the same words again.  Both
tokenizers split text before they merge, and certain white space is always such a
split, so a text's ids are the ids of its chunks, one after another.  A worker
keeps the ids of the chunks it has met, up to a bound, then starts anew.  Arrow
splits the texts and numbers the chunks, so Python sees each distinct chunk of a
run of texts once.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries and characters that a worker's memory of chunks may hold.
MOST_CHUNKS, MOST_CHARS = 1_200_000, 24 << 20


def byte_letters() -> dict[int, str]:
    """The printable character of each byte: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return {b: chr(b) if b in visible else chr(256 + next(spare)) for b in range(256)}


class Known(dict):
    """Chunks and their ids; a new chunk is learned when first looked up."""

    def __init__(self, encoder: ChunkEncoder, lead: str) -> None:
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self[chunk] = self.encoder.learn(chunk, self)
        return ids


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes.

    ``spaced`` says that the tokenizer keeps white space (a byte-level one, whose
    words take one leading space).  Then a chunk ends before a single space or
    newline that stands between two characters that are no white space: no piece
    of the tokenizer's splitting pattern crosses that point.  A text with any
    other white space is encoded whole.  Without ``spaced``, white space only
    separates, and every space or newline ends a chunk.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 65_536
        self.spaced = spaced
        self.model, self.letters = self.library.model, byte_letters()
        self.marks = {"": b"", "\n": self.whole("\n")} | {m: self.whole(m) for m in ",."}
        self.forget()

    def forget(self) -> None:
        self.known, self.heads = Known(self, "Ġ" if self.spaced else ""), Known(self, "")
        self.known[""], self.heads[""] = None if self.spaced else b"", None
        self.chars = 0

    def pack(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def letters_only(self, word: str, kept: Known) -> bytes | None:
        """The ids of letters only, which no splitting pattern cuts; None if normalising may change more than their case."""
        if word.isascii():
            if not self.spaced and (lower := word.lower()) != word:
                return kept[lower]
            raw = kept.lead + word
        else:
            if not self.spaced:
                if not unicodedata.is_normalized("NFC", word):
                    return None
                word = "".join(map(str.lower, word))
                if not word.isalpha():
                    return None
            # the model takes bytes as printable characters; letters of ASCII are their own, a space is the lead
            raw = kept.lead + word.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(raw)])

    def learn(self, chunk: str, kept: Known) -> bytes | None:
        """A chunk's ids: letters with at most a newline before and a mark after by the model, others by the whole tokenizer.

        Letters with a newline or mark look up the letters alone among the kept chunks.
        None for a chunk whose white space belongs with its neighbours'.
        """
        self.chars += len(chunk)
        if chunk.isalpha():
            if (ids := self.letters_only(chunk, kept)) is not None:
                return ids
            return self.whole((" " if kept.lead else "") + chunk)
        line = self.spaced and chunk[:1] == "\n"
        body = chunk[1:] if line else chunk
        mark = body[-1:] if body[-1:] in (",", ".") else ""
        core = body[: len(body) - len(mark)]
        if core.isalpha():
            # other letters may change under normalising, and then go with their mark
            ids = (self.heads if line else kept)[core] if self.spaced or core.isascii() else self.letters_only(core, kept)
            if ids is not None:
                return (self.marks["\n"] if line else b"") + ids + self.marks[mark]
        if self.spaced and (not body or body != body.strip()):
            return None
        return self.whole(chunk if line else (" " if kept.lead else "") + chunk)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Split, number the distinct chunks, look each up once, and join by text; all but the look-up is Arrow's."""
        if len(self.known) + len(self.heads) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.forget()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "), " ")
        values, offsets = parts.flatten(), parts.offsets
        chunks = values.dictionary_encode()
        ids = list(map(self.known.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False)))
        at = chunks.indices
        if self.spaced:  # a text's first chunk has no space before it
            first = offsets[:-1]
            places = at.to_numpy().copy()
            places[first.to_numpy()] = np.arange(len(ids), len(ids) + len(texts))
            ids += map(self.heads.__getitem__, values.take(first).to_pylist())
            at = pa.array(places)
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.large_binary()).take(at))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()
        # null: a chunk there can't stand alone
        return [self.whole(texts[i].as_py()) if ids is None else ids for i, ids in enumerate(joined)]
