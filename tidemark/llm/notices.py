"""8. License scans: pigeonhole-split exact seeds locate candidates, the regex library's bounded-error matching verifies.

Texts are normalised to lower-case words joined by single spaces. A notice may be met with up to ``errors`` edits; cut
into ``errors + 1`` parts, any such place holds one part unchanged. Exact searches for the parts give windows in which
a fuzzy regular expression decides and reports the span and the edits. Exact phrases ("base") are found as well.

Cases: a null or empty text has no words, no labels and score 0; overlapping places of one phrase all count; fuzzy
spans of one notice don't overlap; repeated rows give repeated results; whole texts are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import Memo, slices

# Phrases and the labels of the exact search.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Short notices and the labels of the fuzzy search.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

#: ASCII letters and digits and all bytes of other characters make words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> tuple[str, int]:
    """The words joined by single spaces, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


def base_places(norm: str) -> list[tuple[int, str]]:
    """(character, label) of each place where a phrase's words stand consecutively."""
    out = []
    padded = f" {norm} "
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


@dataclass(frozen=True)
class Span:
    label: str
    notice: str
    start: int  # character of the normalised text
    end: int
    edits: int


class Scanner:
    """Seeds and patterns of notices, with ``errors`` edits for every ``per`` characters, at least one."""

    def __init__(self, notices: dict[str, str] | None = None, per: int = 12):
        self.notices = []
        for notice, label in (NOTICES if notices is None else notices).items():
            errors = max(1, len(notice) // per)
            cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            seeds = [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
            pattern = regex.compile(rf"(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={errors}}}(?![^ ])", regex.BESTMATCH)
            self.notices.append((notice, label, errors, seeds, pattern))
        self.verified = Memo(self._verify, 50_000)

    def _verify(self, key: tuple[int, str]) -> list[tuple[int, int, int]]:
        at, window = key
        pattern, out, start = self.notices[at][4], [], 0
        while m := pattern.search(window, start):
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            start = max(m.end(), start + 1)
        return out

    def scan(self, norm: str) -> list[Span]:
        """All notices met within their edit bounds; ``norm``: a normalised text."""
        out: list[Span] = []
        for i, (notice, label, errors, seeds, _) in enumerate(self.notices):
            windows = []
            for seed, offset in seeds:
                at = norm.find(seed)
                while at >= 0:
                    windows.append((max(0, at - offset - 2 * errors), at - offset + len(notice) + 2 * errors))
                    at = norm.find(seed, at + 1)
            done = 0
            for a, b in merged(windows, len(notice) + 8 * errors):
                a = max(a, done)
                if a >= b:
                    continue
                a, b = (max(done, norm.rfind(" ", 0, a) + 1) if a else 0), (x if (x := norm.find(" ", b)) >= 0 else len(norm))
                for s, e, edits in self.verified[i, norm[a:b]]:
                    if a + s >= done:
                        out.append(Span(label, notice, a + s, a + e, edits))
                        done = a + e
        return out


def merged(windows: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Overlapping windows joined; each window alone where joining would pass ``most`` characters."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(windows)):
        if out and a <= out[-1][1] and b - out[-1][0] <= most:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_scanners: dict[int, Scanner] = {}


def report(text: str | None, scanner: Scanner) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy, spans of one text."""
    norm, n_words = normalised(text)
    base = base_places(norm)
    spans = scanner.scan(norm)
    starts = [norm.count(" ", 0, at) for at in ([min(base)[0], max(base)[0]] if base else [])]
    exact = {label for _, label in base}
    labels = exact | {s.label for s in spans}
    score = 1.0 if base else max((1 - s.edits / len(s.notice) for s in spans), default=0.0)
    return n_words, len(base), *(starts or (None, None)), ",".join(sorted(exact)), ",".join(sorted(labels)), score, len(spans), [{"label": s.label, "start": s.start, "end": s.end, "edits": s.edits} for s in spans]


def scanned(docs: DataFrame, per: int = 12) -> DataFrame:
    """One row per document with words, places, labels, score and the fuzzy spans (in the normalised text)."""
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_fuzzy", pa.int64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(per, Scanner(per=per))
        for batch in slices(batches):
            out = [report(t, scanner) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(n for n, _ in kinds)])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_fuzzy bigint, spans array<struct<label: string, start: bigint, `end`: bigint, edits: bigint>>")
