"""1. SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is cut into chunks before each white-space mark that follows another character, and stops at a chunk's end
are cut off where the two characters stand together in no piece: no merge can cross such a place. Every unit is encoded by an agenda of
adjacent symbol pairs, taken in order of score (ties: leftmost); the agendas of many units advance in lockstep as
rows of an array. Each Arrow batch's new chunks are checked against the sentencepiece library, whose ids stand
should they ever differ.

Models whose normaliser, white-space or user-defined pieces don't fit the cutting into chunks are refused: whole texts,
and each piece between others, are held against the library once for each model.

Cases: null text counts as empty; an empty text has the end id only; ids decode with the library's ``decode``;
repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Recent, slices, without_gc

MARK = "▁"
#: Ends of words that are split off where no piece spans the cut.
STOPS = ".,;:!?"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """One vocabulary: pieces with scores from the model file, the library for checks and for decoding."""

    #: Units of more characters are encoded one by one with a heap; the others in lockstep.
    LONG = 48
    #: Chunks and units remembered in a generation.
    MOST = 60_000

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in usable}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        self.shown = [str(i) for i in range(n)]
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces that hold a white-space mark after other characters are not supported")
        pairs = sorted((self.pieces[p[:i]][1] * n + self.pieces[p[i:]][1], score, at) for p, (score, at) in self.pieces.items() for i in range(1, len(p)) if p[:i] in self.pieces and p[i:] in self.pieces)
        self.pair_keys = np.array([x[0] for x in pairs], np.int64)
        self.pair_scores = np.array([x[1] for x in pairs])
        self.pair_merged = np.array([x[2] for x in pairs], np.int64)
        self.symbol_of = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, (_, at) in self.pieces.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = at
        self.corrected = 0
        self.forget()

    def forget(self) -> None:
        """Let all memories go: at a task's end, as the worker may live on with other work."""
        if self.corrected:
            logging.getLogger(__name__).warning("%d chunks took the library's ids", self.corrected)
        self.chunks, self.units, self.tails = Recent(self.MOST), Recent(self.MOST), {"": ()}

    def _symbol(self, char: str) -> int:
        """The id of a one-character piece; numbers from ``n`` on stand for characters without one."""
        return self.pieces[char][1] if char in self.pieces else self.n + ord(char)

    def _ids(self, symbols: list[int]) -> tuple[int, ...]:
        if max(symbols) < self.n:
            return tuple(symbols)
        return tuple(chain.from_iterable([s] if s < self.n else [self.byte_ids[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")] for s in symbols))

    def _heap(self, unit: str) -> tuple[int, ...]:
        """The agenda of one long unit, as a heap."""
        pieces = self.pieces
        symbols: list[str] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def add(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            if pair in pieces:
                heapq.heappush(agenda, (-pieces[pair][0], left, right, pair))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != merged:
                continue
            symbols[left], symbols[right] = merged, ""
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                add(left, far)
            if before[left] >= 0:
                add(before[left], left)
        return self._ids([pieces[s][1] if s in pieces else self.n + ord(s) for s in symbols if s])

    def _scores(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and merged id of symbol pairs; minus infinity where they make no piece."""
        key = np.where((left >= 0) & (right >= 0) & (left < self.n) & (right < self.n), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_scores[at], -np.inf), self.pair_merged[at]

    def _lockstep(self, units: list[str]) -> list[tuple[int, ...]]:
        """The agendas of many short units, a row each: every round merges each row's best pair, ties leftmost."""
        out: list = [None] * len(units)
        width = max(map(len, units))
        points = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol_of[points].astype(np.int64).reshape(len(units), width)
        s[np.arange(width)[None, :] >= np.fromiter(map(len, units), np.int64, len(units))[:, None]] = -1
        own = np.arange(len(units))
        score, merged = self._scores(s[:, :-1], s[:, 1:])
        while len(own):
            at = score.argmax(1) if score.shape[1] else np.zeros(len(own), np.int64)
            go = score[np.arange(len(own)), at] > -np.inf if score.shape[1] else np.zeros(len(own), bool)
            if not go.all():
                done = s[~go]
                odd = (done >= self.n).any(1)
                for i, row, size, x in zip(own[~go].tolist(), done.tolist(), (done >= 0).sum(1).tolist(), odd.tolist(), strict=True):
                    out[i] = self._ids(row[:size]) if x else tuple(row[:size])
                own, s, score, merged, at = own[go], s[go], score[go], merged[go], at[go]
            if not len(own):
                break
            rows, j = np.arange(len(own)), at[:, None]
            new = merged[rows, at]
            c = np.arange(s.shape[1] - 1)[None, :]
            s = np.take_along_axis(s, c + (c > j), 1)
            s[rows, at] = new
            c = np.arange(score.shape[1] - 1)[None, :]
            score, merged = np.take_along_axis(score, c + (c >= j), 1), np.take_along_axis(merged, c + (c >= j), 1)
            for k in (at - 1, at):
                ok = (k >= 0) & (k < score.shape[1])
                r, k = rows[ok], k[ok]
                score[r, k], merged[r, k] = self._scores(s[r, k], s[r, k + 1])
        return out

    def _agenda(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        found = {u: self._heap(u) if len(u) > self.LONG else self._ids([self._symbol(u)]) for u in units if len(u) > self.LONG or len(u) == 1}
        rest = sorted((u for u in units if u not in found), key=len)
        for i in range(0, len(rest), 4096):
            found.update(zip(rest[i : i + 4096], self._lockstep(rest[i : i + 4096]), strict=True))
        return found

    def _learn(self, keys: list[str]) -> None:
        """Encode chunks (given without their first white-space mark); those with a new unit are held against the library."""
        joined, units, tails = self.joined, self.units.now, self.tails
        cut, need, stops = [], set(), STOPS
        for key in keys:
            unit = key.rstrip(stops)
            if unit and len(unit) < len(key) and key[len(unit) - 1 : len(unit) + 1] not in joined:
                cut.append((MARK + unit, key[len(unit) :]))
            else:
                cut.append((MARK + key, ""))
        need = self.units.missing({u for u, _ in cut})
        if need:
            units.update(self._agenda(list(need)))
        if ends := {t for _, t in cut} - tails.keys():
            tails.update(self._agenda([t for t in ends if t]))
        ids = [units[u] + tails[t] for u, t in cut]
        check = [i for i, (u, t) in enumerate(cut) if keys[i] and (u in need or t in ends)]
        for i, want in zip(check, self.library.encode([keys[i] for i in check], num_threads=1), strict=True):
            if ids[i] != tuple(want):
                self.corrected += 1
                ids[i] = tuple(want)
                # other chunks may hold the same unit or tail, so these are put right too
                unit, tail = cut[i]
                units[unit] = right = tuple(self.library.encode(unit[len(MARK) :]))
                if tail and ids[i][: len(right)] == right:
                    tails[tail] = ids[i][len(right) :]
        self.chunks.now.update(zip(keys, ids, strict=True))

    def chunks_of(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        return [x[1:] for x in _CHUNKS.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, without an end id, and the same as decimal numbers joined by one space."""
        start = size = 0
        for i, text in enumerate([*texts, None]):
            if text is None or size > 1_000_000:
                yield from self._encode([self.chunks_of(t) for t in texts[start:i]])
                start, size = i, 0
            size += len(text or "")

    def _encode(self, parts: list[list[str]]) -> Iterator[tuple[list[int], str]]:
        self.chunks.turn()
        self.units.turn()
        if len(self.tails) > 10_000:
            self.tails = {"": ()}
        if need := self.chunks.missing(set().union(*parts)):
            self._learn(list(need))
        get, shown = self.chunks.now.__getitem__, self.shown.__getitem__
        for part in parts:
            ids = list(chain.from_iterable(map(get, part)))
            yield ids, " ".join(map(shown, ids))


#: Texts on which a model must agree with its cutting into chunks.
PROBES = ("", " ", "a", " a", "a ", "  a   b  ", f"{MARK}a{MARK}{MARK} b", "\t\n a\r\n\u00a0\u3000b\u200b", "ﬁ Ａ① é e\u0301 Å", "A b.C,d;e :f ?g!", "x" * 70, "漢字 \U0001f600 <s> </s> <unk> <0x41>")

_codecs: dict[str, Codec] = {}
_checked: set[str] = set()


def codec(model_file: str) -> Codec:
    """One codec for each worker and model."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def check(model_file: str) -> str | None:
    """A text that the model encodes in a way that the codec doesn't, if one is found."""
    c = codec(model_file)
    texts = [*PROBES, *(f"a{p.replace(MARK, ' ')}b {p.replace(MARK, ' ')}" for p in c.pieces)]
    found = next((t for t, (ids, _), want in zip(texts, c.encode(texts), c.library.encode(texts, num_threads=1), strict=True) if ids != want), None)
    c.forget()
    return found


def checked(spark: SparkSession, model_file: str) -> None:
    """Raise if the codec can't stand for the model; once for each model, by one task, so that the driver holds no codec."""
    if model_file in _checked:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([check(model_file)], pa.string())], ["text"])

    found = spark.range(1, numPartitions=1).mapInArrow(run, "text string").first().text
    if found is not None:
        raise ValueError(f"{model_file} encodes {found!r} in a way that this codec doesn't")
    _checked.add(model_file)


def encoded(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """``id_col, ids array<int>`` of every whole text; null texts give the end id alone, or no id; repeated rows repeat."""
    checked(df.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        with without_gc():
            for batch in slices(batches):
                ids = [x[0] + [c.end] * add_end for x in c.encode([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])
            c.forget()

    source = df.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from arrays of ids; null and empty arrays give an empty text; ids outside the vocabulary raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = codec(model_file).library
        for batch in slices(batches):
            texts = [library.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    source = df.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes``: each whole text encoded with an end id, then decoded."""
    checked(df.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        with without_gc():
            for batch in slices(batches):
                out: list[tuple] = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, (ids, shown) in zip(batch.column("doc_id").to_pylist(), c.encode(texts), strict=True):
                    ids.append(c.end)
                    shown = f"{shown} {c.end}" if shown else str(c.end)
                    back = c.library.decode(ids).encode("utf-8", "surrogatepass")
                    out.append((doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])
            c.forget()

    source = df.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
