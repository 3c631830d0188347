"""License scans: fuzzy search for short notices.

A notice of k allowed edits is split into k + 1 pieces; wherever it occurs with at most k
edits, one piece occurs exactly. One automaton finds all pieces of all notices; around each
find, the window in which the whole notice would lie (k characters wider at both ends) is
searched by the regex library for the best match within k edits (insertions, deletions,
substitutions), and what lies before and after that match is searched in the same way. Windows
of a notice that overlap are searched as one. Case is ignored for
ASCII letters, and each white space character counts as a blank.

Defined cases: a null or empty text has no spans; rows are taken one by one, so repeated rows
each give theirs; of matches of one notice that overlap, the regex library's leftmost best is
given, and matches beside it too, and where notices of different licenses overlap, those of the fewest edits; a very long text is searched whole; no rows in give no rows out; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTICES = {
    "apache-2.0": "licensed under the apache license, version 2.0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "gpl": "licensed under the gnu general public license, version",
    "lgpl": "gnu lesser general public license",
    "mpl-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "bsd": "redistribution and use in source and binary forms, with or without modification",
    "cc-by-nc": "licensed under cc by-nc 4.0",
    "cc-by-sa": "licensed under cc by-sa 4.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}
_BLANK = bytes.maketrans(b"\t\n\r\f\v", b"     ")


MOST_EDITS = 4


def edits(notice: str, most: int = MOST_EDITS) -> int:
    """One edit for each ten characters, ``most`` at most."""
    return min(most, len(notice) // 10)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their places."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


def plain(text: str) -> str:
    """The text as it is compared, character by character."""
    return text.encode("utf-8", "surrogatepass").translate(_BLANK).lower().decode("utf-8", "surrogatepass")


class Finder:
    def __init__(self, notices: dict[str, str], most: int = MOST_EDITS):
        self.names = list(notices)
        self.notices = [plain(notices[n]) for n in self.names]
        self.edits = [edits(x, most) for x in self.notices]
        self.search = [regex.compile(f"(?b)(?:{regex.escape(x)}){{e<={k}}}") for x, k in zip(self.notices, self.edits)]
        seeds: dict[str, list] = {}
        for i, (x, k) in enumerate(zip(self.notices, self.edits)):
            for at, piece in pieces(x, k):
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _matches(self, i: int, low: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the notice in the window: the best match, then those before and after it."""
        shortest, parts = len(self.notices[i]) - self.edits[i], [(a, b)]
        while parts:
            a, b = parts.pop()
            if b - a >= shortest and (m := self.search[i].search(low, a, b)):
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                parts += [(a, m.start()), (m.end(), b)]

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(license, start, end, edits), by license and start."""
        low, windows = plain(text), {}
        for last, (size, where) in self.automaton.iter(low):
            for i, at in where:
                k, a = self.edits[i], last + 1 - size - at
                a, b = max(0, a - k), min(len(low), a + len(self.notices[i]) + k)
                own = windows.setdefault(i, [])
                own.append((a, b))
        out = []
        for i in sorted(windows):
            merged: list[list[int]] = []
            for a, b in sorted(windows[i]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                out += sorted((self.names[i], *found) for found in self._matches(i, low, a, b))
        return fewest(out)


def fewest(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The spans that no span of another license with fewer edits overlaps; each is compared with those that begin shortly before or within it only."""
    by = sorted(spans, key=lambda s: s[1])
    starts, longest = [s[1] for s in by], max((s[2] - s[1] for s in by), default=0)

    def beaten(x: tuple) -> bool:
        near = by[bisect_left(starts, x[1] - longest) : bisect_left(starts, x[2])]
        return any(y[3] < x[3] and y[0] != x[0] and x[1] < y[2] for y in near)

    return [x for x in spans if not beaten(x)]


SPANS = "doc_id bigint, license string, span_start int, span_end int, edits int"
_finders: dict[tuple, Finder] = {}


def finder(notices: dict[str, str], most: int = MOST_EDITS) -> Finder:
    if (k := (most, *notices.items())) not in _finders:
        _finders[k] = Finder(notices, most)
    return _finders[k]


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] = NOTICES, most_edits: int = MOST_EDITS) -> DataFrame:
    """A row for each occurrence: doc_id, license, span_start and span_end in characters, and the number of edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(notices, most_edits).spans
        for b in batches:
            rows = [(i, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s in find(t)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "span_start", "span_end", "edits"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SPANS)
