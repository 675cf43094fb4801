"""Secret scan: fixed patterns, then dictionary-primed zstandard novelty.

Base kinds are patterns.  The method adds kind ``novel``: a token-like string
close after a sensitive word, measured by its marginal compressed bytes: how many
bytes zstandard adds for it when primed with a dictionary of code identifiers and
with the text around it.  Ordinary words and identifiers, or repetitions of what
stands near, cost little; keys and passwords cost about their own length.  Every
such string in reach of the word is measured; the reach goes on after a novel one.
The lines of a private key block are measured as one and reported one by one.
Copies after another sensitive word, or over REACH characters away, do not make a string
familiar, and a string found novel is reported wherever it stands again; a nearer copy
under the same sensitive word, or under none, counts as text around.

A string is close if it begins at most REACH characters after the sensitive word, or
after a novel string that is; what stands further is not measured.  A novel string of
letters whose letter triples the text's own words or the dictionary know is a word of a
language or an identifier made of words, and no finding.

Null text counts as empty and has no spans.  Repeated rows give repeated results, an
empty table none.  Extra columns do not matter to ``scan`` and pass ``redact`` as they
are.  Whole texts of any length are scanned; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

def triples(words: Iterable[str]) -> set[str]:
    return {w[i : i + 3] for w in words for i in range(len(w) - 2)}


#: A word that makes what follows it sensitive.
CONTEXT = re.compile(
    r"""(?i:authorization|bearer|credentials?|private[_ -]?key|access[_ -]?key|client[_ -]?secret|passphrase|passcode|signing[_ -]?key|connection[_ -]?string|password|passwd|secret|token|api[ _-]?key)"""
    r"""["']?\x20*[:=]?\x20*["']?""",
    re.ASCII,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: After a private key's words: the end of the block's first line and its headers; then its lines, the last one of any length.
BLOCK = re.compile(r"(?i:\x20BLOCK)?-----(?:\\r|\\n|\s)*(?:[A-Za-z][A-Za-z-]*:\x20[^\n]*\n\s*)*")
LINE = re.compile(r"""((?:\\r|\\n|[\s"',;>#*|])*)([A-Za-z0-9+/=]+)(?=[\x20\t"',;]*(?:\r|\n|\\r|\\n|\Z|-----))""")
#: Characters after the sensitive word in which a candidate must start; characters of context that prime the compressor.
REACH, AROUND = 24, 256
#: Share of a candidate's cost that must be new.
NOVEL = 0.8
#: Share of its characters in runs of letters, and of those runs' triples that must be known, for a string to count as words.
LETTERS, KNOWN = 0.8, 0.5
RUN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
#: Words that show a language's triples; keys are longer.
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{3,11}(?![^\W_])")
IDENTIFIERS = (
    "Authorization Bearer credentials private_key access_key client_secret passphrase passcode signing_key "
    "connection_string example placeholder changeme your_api_key_here configuration environment variable "
    "username password function return import string number object default localhost application production "
    "authentication information documentation implementation communication organization administration "
    "international understanding development environmental responsibility characteristics representative "
    "approximately particularly significantly unfortunately nevertheless notwithstanding circumstances "
    "requirements relationship professional considerable opportunities performance transformation investigation "
    "recommendation specification identification classification verification notification subscription description "
    "management department government establishment measurement achievement announcement manufacturing engineering "
    "programming processing networking infrastructure architecture technological traditional constitutional "
    "distribution contribution construction instruction introduction interpretation presentation demonstration "
    "effectiveness consciousness availability compatibility possibilities security certificate encryption decryption "
    "repository dependencies controller service manager handler client server request response session database "
    "knowledge experience difference conference reference independent comprehensive extraordinary straightforward "
    "development abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 xxxxxxxxxxxx"
).encode()
#: Of its words; the alphabets and digits at its end are none.
IDENTIFIER_TRIPLES = triples(w.lower() for w in IDENTIFIERS.decode().split() if w.isalpha() and w.islower() and "xyz" not in w and "xxx" not in w)


def cost(raw: bytes, before: bytes) -> int:
    """Bytes zstandard adds for ``raw`` after ``before``."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False).compress
    return len(compress(raw)) - len(compress(b""))


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of ``candidate`` after ``around``, by those a string without repetition would cost.

    Up to 48 characters these are its own bytes.  zstandard codes longer strings
    by the frequency of their characters, so there the same characters, shuffled,
    are the measure; at least 0.4 of the bytes, or one repeated letter would count.
    """
    raw, before = candidate.encode(), IDENTIFIERS + b" " + around.encode("utf-8", "replace")
    whole = len(raw)
    if len(raw) > 48:
        rng = random.Random(len(raw))
        # near 64 bytes a chance match decides whether frequencies are used at all
        shuffles = [bytes(rng.sample(raw, len(raw))) for _ in range(8 if len(raw) <= 128 else 1)]
        whole = max(min(cost(x, before) for x in shuffles), 0.4 * len(raw))
    return cost(raw, before) / whole


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def key_lines(text: str, at: int) -> list[tuple[int, int]]:
    """The lines of a private key block of which the words end at ``at``."""
    found: list[tuple[int, int]] = []
    if head := BLOCK.match(text, at):
        at = head.end()
        while m := LINE.match(text, at):
            last = m.end() - m.start(2) < 12
            if found and not re.search(r"[\r\n]|\\[rn]", m[1]) or last and not found:
                break
            found.append(m.span(2))
            at = m.end()
            if last:
                break
    return found


def worded(candidate: str, known: set[str]) -> bool:
    """Whether a string is made of words, by the letter triples that are known."""
    runs = [r.lower() for r in RUN.findall(candidate)]
    if sum(map(len, runs)) < LETTERS * len(candidate):
        return False
    parts = [r[i : i + 3] for r in runs for i in range(len(r) - 2)]
    return sum(p in known for p in parts) >= KNOWN * len(parts)


def surroundings(text: str, start: int, end: int, words: list[str], sensitive: list[int]) -> str:
    """The text around, without copies of ``words`` that stand over REACH away, or as near after another sensitive word (by their ends)."""
    own = bisect_right(sensitive, start)
    reach = max(REACH, start - sensitive[own - 1])
    out = []
    for lo, hi in ((max(0, start - AROUND), start), (end, min(len(text), end + AROUND))):
        cuts = []
        for word in words:
            at = text.find(word, max(0, lo - len(word) + 1), hi + len(word) - 1)
            while at >= 0:
                k = bisect_right(sensitive, at)
                far = max(at - end, start - at - len(word)) > REACH
                if far or k and k != own and at - sensitive[k - 1] <= reach or len(words) > 1 and k != own:
                    cuts.append((at, at + len(word)))
                at = text.find(word, at + len(word), hi + len(word) - 1)
        for a, b in sorted(cuts):
            out.append(text[lo : max(a, lo)])
            lo = max(lo, b)
        out.append(text[lo:hi])
    return "".join(out)


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Novel strings in sensitive context, wherever they stand again, that no base span covers."""
    matches = list(CONTEXT.finditer(text))
    sensitive = [m.end() for m in matches]
    found, past, measured = set(), 0, set()
    known: set[str] = set()

    def new(spans: list[tuple[int, int]]) -> bool:
        words = [text[a:b] for a, b in spans]
        start, end = spans[0][0], spans[-1][1]
        if novelty("".join(words), surroundings(text, start, end, words, sensitive)) < NOVEL:
            return False
        if not known:
            known.update(IDENTIFIER_TRIPLES, triples(w.lower() for w in set(WORD.findall(text))))
        return not all(worded(w, known) for w in words)

    def covered(start: int, end: int) -> bool:
        return any(a <= start and end <= b for a, b, _ in taken)

    for m in matches:
        if m.end() >= past and (lines := key_lines(text, m.end())) and new(lines):
            found.update(lines)
            past = lines[-1][1]
            continue
        at, limit = max(m.end(), past), m.end() + REACH
        while (c := CANDIDATE.search(text, at, limit + 12)) and c.start() <= limit:
            c = CANDIDATE.match(text, c.start())
            at = c.end()
            if c.start() in measured:
                continue
            measured.add(c.start())
            if not covered(*c.span()) and new([c.span()]):
                found.add(c.span())
                past, limit = c.end(), c.end() + REACH
    for word in {text[a:b] for a, b in found if b - a >= 12}:
        at = text.find(word)
        while at >= 0:
            found.add((at, at + len(word)))
            at = text.find(word, at + len(word))
    return [(a, b, "novel") for a, b in sorted(found) if not covered(a, b)]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with its counts, the digest of base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    spans = spans_of(text)
                    base = [s for s in spans if s[2] != "novel"]
                    n = [sum(s[2] == kind for s in spans) for kind in KINDS]
                    rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)], SPANS.replace(" bigint", "").replace(" string", "").split(", "))

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")), run, SPANS)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in spans_of(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text.

    Texts without a secret, null ones among them, stay as they are.  Where
    ``length_column`` is a whole number of 32 or 64 bits, it follows a text that has
    changed; a column of that name of another kind stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column):
                i = batch.schema.get_field_index(text_column)
                texts = batch.column(i).to_pylist()
                new = [t if t is None else redacted(t) for t in texts]
                columns = batch.columns
                if new != texts:
                    columns[i] = pa.array(new, pa.string())
                    j = batch.schema.get_field_index(length_column)
                    if j >= 0 and batch.schema.field(j).type in (pa.int32(), pa.int64()):
                        lengths = batch.column(j)
                        columns[j] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, lengths.to_pylist())], lengths.type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
