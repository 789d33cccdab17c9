"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits contains at least one of its k + 1 parts unchanged (pigeonhole), so all parts of all notices
are searched at once in one pass over the words of a text; only around a hit the regex library verifies the edits.

Defined results: a null text is empty and gives zero words, empty labels and score 0; every row is scanned by itself, so
repeated rows repeat; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import encoded

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices (words as the scanner sees them), their labels and the edits allowed in each.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("this program is free software you can redistribute it and or modify it", "gpl", 7),
    ("gnu lesser general public license", "lgpl", 2),
    ("licensed under the apache license", "apache", 4),
    ("apache license version 2 0", "apache", 3),
    ("released under the mit license", "mit", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license", "mpl", 2),
    ("licensed under cc by", "cc-by", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("creative commons attribution", "cc-by", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
]
#: A-Z to lower case; every byte outside 0-9, a-z and non-ASCII parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, notice: string, start_word: long, end_word: long, start_byte: long, end_byte: long, edits: int>>"
)


def parts(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, part): the notice split into ``edits + 1`` parts of nearly equal length."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """The seeds of all notices in one automaton, and the bounded-error pattern of each notice."""

    def __init__(self, notices: list[tuple[str, str, int]] = NOTICES) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={k}}}") for n, _, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (notice, _, k) in enumerate(notices):
            for offset, part in parts(notice, k):
                seeds.setdefault(part, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every place in normalised text; of overlapping ones the one with fewest edits.

        A notice within k edits holds a seed that puts its start at most k away, so seeds whose starts lie within 2k share a
        window; no window is longer than the notice and four times its edits, which keeps the work linear in the text.
        """
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for at, offset in places:
                windows.setdefault(at, []).append(end + 1 - size - offset)
        found = []
        for at, starts in windows.items():
            notice, _, k = self.notices[at]
            starts.sort()
            own, head = [], 0
            for i in range(1, len(starts) + 1):
                if i == len(starts) or starts[i] - starts[head] > 2 * k:
                    low, high = max(0, starts[head] - k), min(starts[i - 1] + len(notice) + k, len(text))
                    own += self._places(at, text, low, high)
                    head = i
            found += [(at, *place) for place in _apart(own)]
        return found

    def _places(self, at: int, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) in one window: its best match, then what stands before and after it."""
        notice, _, k = self.notices[at]
        out, todo = [], [(low, high)]
        while todo:
            low, high = todo.pop()
            m = self.patterns[at].search(text, low, high) if high - low >= len(notice) - k else None
            if m and m.end() > m.start():
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(low, m.start()), (m.end(), high)]
        return out


def _apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Places that do not overlap, those with fewer edits first, in text order."""
    kept: list[tuple[int, int, int]] = []
    for start, end, edits in sorted(set(places), key=lambda p: (p[2], p[0], -p[1])):
        i = bisect.bisect_left(kept, (start,))
        if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or kept[i][0] >= end):
            kept.insert(i, (start, end, edits))
    return kept


def _blanks(padded: bytes) -> np.ndarray:
    """Places of the blanks in ``padded``: the number of them before a place is the number of the word there."""
    return np.flatnonzero(np.frombuffer(padded, dtype=np.uint8) == 32)


def _phrase_places(padded: bytes, blanks: np.ndarray) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively; ``padded`` has a space on both ends."""
    out = []
    for phrase, label in PHRASES.items():
        needle, hits = b" " + phrase.encode() + b" ", []
        at = padded.find(needle)
        while at >= 0:
            hits.append(at)
            at = padded.find(needle, at + 1)
        out += [(int(w), label) for w in np.searchsorted(blanks, hits)] if hits else []
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): phrase places, labels, score and the spans of notices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch()
        schema = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), encoded(batch.column("text"))):
                words = text.translate(_FOLD).split()
                padded = b" " + b" ".join(words) + b" "
                blanks = _blanks(padded)
                places = _phrase_places(padded, blanks)
                plain = padded.decode("latin-1")
                spans, where = [], None
                for at, start, end, edits in search(plain):
                    notice, label, _ = search.notices[at]
                    first = int(np.searchsorted(blanks, start + (plain[start] == " "))) - 1
                    last = max(first, int(np.searchsorted(blanks, end - (plain[end - 1] == " "))) - 1)
                    where = where or [m.span() for m in _WORD.finditer(text)]
                    spans.append({
                        "label": label, "notice": notice, "start_word": first, "end_word": last + 1,
                        "start_byte": where[first][0], "end_byte": where[last][1], "edits": edits,
                    })
                base = sorted({label for _, label in places})
                starts = [w for w, _ in places]
                rows.append({
                    "doc_id": doc_id.as_py(), "n_words": len(words), "n_base": len(places),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
                    "score": 1.0 if places else max((1.0 - s["edits"] / len(s["notice"]) for s in spans), default=0.0),
                    "spans": spans,
                })
            schema = schema or _arrow_schema()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    span = pa.struct([
        ("label", pa.string()), ("notice", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()),
        ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int32()),
    ])
    return pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(span)),
    ])
