"""Licence scan: Dice coefficient over word bigrams, by DataFrame functions only.

A text is compared segment by segment: its lines, sentences, paragraphs, the whole,
and runs of words as long as a template, laid where a mark (below) stands as in the
template; so line ends, comment marks and text around do not matter.  Segment and template are lower-cased sets of word bigrams.  With Dice at
least ``t``, sizes a and b obey ``a >= b*t/(2-t)`` and ``a <= b*(2-t)/t``; templates
outside those bounds are pruned before any set is intersected, and a segment of
more distinct words than that allows before its bigrams are made.  Likewise an
overlap of at least ``b*t/(2-t)`` bigrams is needed, so of any set of a template's
bigrams larger than the rest one must occur.  The longest bigrams of each template
are such a set, its marks: texts and segments without a mark are passed over, and a
run that matches holds one.  None of these bounds loses a match.

Null and empty texts, and segments of fewer than two words, match nothing.
Runs overlap, so of runs only a template's best match counts, once and where no
other segment matches it as well.  Repeated segments of a text count once; equal scores go to the first name by
alphabet.  Repeated rows give repeated results, an empty table none.  Texts of any
length are compared whole; extra columns, also such as ``dice``, do not matter.
"""

from __future__ import annotations

import json
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

THRESHOLD = 0.8
#: Licence notices and terms, as their publishers give them (fixed values).
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0 disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD notice": "Licensed under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
FULL_TEXTS = files(__package__) / "license_texts.txt"


def read_templates(text: str) -> dict[str, str]:
    """The templates of a file: ``== NAME`` begins a text, ``#`` lines before the first are comments."""
    parts = re.split(r"^== (.+)$", text, flags=re.M)
    return {name.strip(): body.strip() for name, body in zip(parts[1::2], parts[2::2])}


#: Notices and full texts, by name.
ALL_TEMPLATES = TEMPLATES | read_templates(FULL_TEXTS.read_text(encoding="utf-8"))
WORD_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK, PARAGRAPH_BREAK = r"(?<=[.!?:])[ \t]+", r"\n[ \t\r]*\n"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_marks(text: str, threshold: float = THRESHOLD) -> list[str]:
    """A template's longest bigrams, one more than a match may lack."""
    grams = sorted(template_bigrams(text), key=lambda g: (-len(g), g))
    spare = len(grams) - len(grams) * threshold / (2 - threshold)
    return grams[: int(spare + 1e-9) + 1]


def marks(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of which a segment must have one to match any template."""
    return sorted({mark for text in templates.values() for mark in template_marks(text, threshold)})


def any_of(words: list[str]) -> str:
    """A pattern of the words (a space in them is a word break) that branches by letters, so most positions fail at the first."""
    found: dict[str, list[str]] = {}
    for word in filter(None, words):
        found.setdefault(word[0], []).append(word[1:])
    branches = [(WORD_BREAK if c == " " else re.escape(c)) + any_of(rest) for c, rest in sorted(found.items())]
    if not branches:
        return ""
    if len(branches) == 1 and "" not in words:
        return branches[0]
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


def mark_pattern(templates: dict[str, str], threshold: float = THRESHOLD) -> str:
    """Finds every mark in lower-cased text; a second word that only begins like a mark's is found too."""
    return r"(?<![\p{L}\p{N}])" + any_of(marks(templates, threshold))


def places(templates: dict[str, str], threshold: float = THRESHOLD) -> dict[str, list[tuple[int, int]]]:
    """For each mark where it stands in its templates, in words from their start, and their lengths."""
    found: dict[str, set[tuple[int, int]]] = {}
    for text in templates.values():
        words, chosen = template_words(text), set(template_marks(text, threshold))
        for i, pair in enumerate(zip(words, words[1:])):
            if " ".join(pair) in chosen:
                found.setdefault(" ".join(pair), set()).add((i, len(words)))
    return {mark: sorted(p) for mark, p in sorted(found.items())}


def segments(text: Column) -> Column:
    lines, paragraphs = F.split(text, "\n"), F.split(text, PARAGRAPH_BREAK)
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_BREAK)))
    return F.array_distinct(F.concat(lines, sentences, paragraphs, F.array(text)))


def words_of(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), WORD_BREAK), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    # one word has no bigram; the lengths are never below zero
    left = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    right = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))


def constant(value: object, kind: str) -> Column:
    """A nested constant as one literal; the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def runs(text: Column, templates: dict[str, str], threshold: float = THRESHOLD) -> Column:
    """Bigrams of the text's runs of words laid by marks."""
    known = places(templates, threshold)
    table = constant({mark: [{"i": i, "n": n} for i, n in p] for mark, p in known.items()}, "map<string,array<struct<i:int,n:int>>>")

    def of(words: Column) -> Column:
        pair = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
        # a run cut by the text's start is so much shorter
        start = lambda i: lambda p: F.struct(F.greatest(i - p["i"], F.lit(0)).alias("start"), (p["n"] + F.least(i - p["i"], F.lit(0))).alias("n"))
        marked = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: pair(i).isin(*known))
        spans = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.transform(F.element_at(table, pair(i)), start(i)))))
        return F.transform(spans, lambda s: bigrams_of(F.slice(words, s["start"] + 1, s["n"])))

    # the words stand in an array of one, so that they are split once
    return F.flatten(F.transform(F.array(words_of(text)), of))


def matches(text: Column, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """The text's matching segments: array of (dice, name), the best template of each."""
    none = F.array().cast("array<struct<minus:double,name:string>>")
    grams = {name: g for name, t in sorted(templates.items()) if (g := template_bigrams(t))}
    if not grams:
        return none
    up = (2 - threshold) / threshold
    known = constant([{"name": name, "grams": g, "n": len(g)} for name, g in grams.items()], "array<struct<name:string,grams:array<string>,n:int>>")
    least, most = min(map(len, grams.values())) / up, max(map(len, grams.values())) * up
    sized = lambda sets: F.filter(sets, lambda s: (F.size(s) >= least) & (F.size(s) <= most))

    def best(s: Column) -> Column:
        fit = F.filter(known, lambda k: (F.size(s) * up >= k["n"]) & (F.size(s) <= k["n"] * up))
        scored = F.transform(fit, lambda k: F.struct((-2.0 * F.size(F.array_intersect(s, k["grams"])) / (F.size(s) + k["n"])).alias("minus"), k["name"].alias("name")))
        return F.array_min(scored)

    enough = lambda sets: F.filter(F.transform(sized(sets), best), lambda b: b["minus"] <= -threshold + 1e-12)

    def merged(both: Column) -> Column:
        better = lambda r: ~F.exists(both["s"], lambda o: (o["name"] == r["name"]) & (o["minus"] <= r["minus"])) & ~F.exists(both["r"], lambda o: (o["name"] == r["name"]) & (o["minus"] < r["minus"]))
        return F.concat(both["s"], F.array_distinct(F.filter(both["r"], better)))

    hint = mark_pattern(templates, threshold)
    worded = F.transform(F.filter(segments(text), lambda s: F.lower(s).rlike(hint)), words_of)
    fitting = F.filter(worded, lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most))
    of_segments = enough(F.transform(fitting, bigrams_of))
    found = F.flatten(F.transform(F.array(F.struct(of_segments.alias("s"), enough(runs(text, templates, threshold)).alias("r"))), merged))
    return F.when(F.lower(text).rlike(hint), found).otherwise(none)


def scan(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_matches, license (best match, else null), dice, licenses (all names, by alphabet) of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), matches(text_of(text_column), templates, threshold).alias("found"))
    top = F.array_min("found")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda b: b["name"])))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_matches"), top["name"].alias("license"), F.round(-top["minus"], 6).alias("dice"), F.array_join(names, ",").alias("licenses"))
