"""Fuzzy search for short license notices.

A notice of m characters may differ by k edits.  Cut into k + 1 pieces, at least one piece of
an occurrence is exact (pigeonhole), so one pass of an Aho-Corasick automaton over the pieces
finds every candidate; the ``regex`` library's bounded-error matching then verifies the
surroundings and gives the span and the edits.  Texts are compared as lower-cased words joined
by single spaces, so punctuation and line breaks do not count as edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes
from .words import plain_words

# fixed values: notices and their labels, in words
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "apache software license version"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc by nc", "licensed under cc by nc 4 0"),
    ("cc by sa", "licensed under cc by sa 4 0"),
    ("cc by", "licensed under cc by 4 0"),
    ("cc", "creative commons attribution"),
    ("reserved", "all rights reserved"),
)
# fixed values: exact phrases that always count
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# one edit for so many characters of a notice, one at least
CHARS_PER_EDIT = 16
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64())]))),
        (
            "notices",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("notice", pa.string()),
                        ("first_word", pa.int64()),
                        ("n_words", pa.int64()),
                        ("first_char", pa.int64()),
                        ("n_chars", pa.int64()),
                        ("edits", pa.int64()),
                        ("similarity", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)
FOUND_DDL = (
    "struct<n_words: bigint, phrases: array<struct<label: string, phrase: string, first_word: bigint>>, notices: array<struct<label: string, "
    "notice: string, first_word: bigint, n_words: bigint, first_char: bigint, n_chars: bigint, edits: bigint, similarity: double>>>"
)


class Scanner:
    """The compiled notices of one task."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, chars_per_edit: int = CHARS_PER_EDIT):
        self.phrases = [(label, phrase, f" {phrase} ".encode()) for label, phrase in phrases]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (label, notice) in enumerate(notices):
            edits = max(1, len(notice) // chars_per_edit)
            pattern = regex.compile(rf"(?b)(?: {regex.escape(notice)} ){{e<={edits}}}")
            self.notices.append((label, notice, edits, pattern))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> dict:
        words = plain_words(text)
        joined = b" " + b" ".join(words) + b" "
        phrases = []
        for label, phrase, wanted in self.phrases:
            at = joined.find(wanted)
            while at >= 0:
                phrases.append({"label": label, "phrase": phrase, "first_word": joined.count(b" ", 0, at)})
                at = joined.find(wanted, at + 1)
        phrases.sort(key=lambda p: (p["first_word"], p["label"]))
        return {"n_words": len(words), "phrases": phrases, "notices": self._notices(joined.decode(), text) if words else []}

    def _notices(self, joined: str, text: bytes) -> list[dict]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(joined):
            for number, offset in where:
                _, notice, edits, pattern = self.notices[number]
                # the piece begins `offset` characters into the notice, moved by `edits` at most
                start = end - size + 1 - offset - 1
                if (number, start) in tried:
                    continue
                tried.add((number, start))
                low = max(0, start - edits)
                match = pattern.search(joined, low, start + len(notice) + 2 + edits)
                if match:
                    key = (number, match.start())
                    cost = sum(match.fuzzy_counts)
                    if key not in best or (cost, -match.end()) < (best[key][1], -best[key][0]):
                        best[key] = (match.end(), cost)
        if not best:
            return []
        kept: list[tuple[int, int, int, int]] = []
        # of overlapping matches of one notice the one with fewest edits stays, then the leftmost
        for (number, start), (end, cost) in sorted(best.items(), key=lambda m: (m[0][0], m[1][1], m[0][1])):
            if not any(n == number and start < e - 1 and s < end - 1 for n, s, e, _ in kept):
                kept.append((number, start, end, cost))
        spans = [(m.start(), m.end()) for m in WORD.finditer(text.decode())]
        out = []
        for number, start, end, cost in sorted(kept, key=lambda k: (k[1], k[0])):
            label, notice, _, _ = self.notices[number]
            first = joined.count(" ", 0, start + 1) - 1
            last = min(max(joined.count(" ", 0, end - 1) - 1, first), len(spans) - 1)
            first = min(max(first, 0), last)
            begin, stop = spans[first][0], spans[last][1]
            out.append({"label": label, "notice": notice, "first_word": first, "n_words": last - first + 1, "first_char": begin, "n_chars": stop - begin, "edits": cost, "similarity": 1.0 - cost / len(notice)})
        return out


@lru_cache(maxsize=4)
def scanner(notices: tuple, phrases: tuple, chars_per_edit: int) -> Scanner:
    return Scanner(notices, phrases, chars_per_edit)


def scan(docs: DataFrame, notices: tuple = NOTICES, phrases: tuple = PHRASES, chars_per_edit: int = CHARS_PER_EDIT, into: str = "licenses") -> DataFrame:
    """``docs`` with ``into(n_words, phrases, notices)``; one row in, one row out.

    ``phrases``: exact places of ``phrases`` (word numbers from 0, in text order); ``notices``: fuzzy
    places with word and character spans, edits and similarity, in text order.  A null or empty text
    has no words and no places.
    """

    @F.arrow_udf(FOUND_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = scanner(notices, phrases, chars_per_edit)
        for texts in batches:
            yield pa.array([held.scan(t) for t in as_bytes(texts)], FOUND)

    return docs.withColumn(into, run(F.col("text").cast("string")))


def labels(found, which: str):
    """Sorted distinct labels, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(found[which]["label"])), ",")
