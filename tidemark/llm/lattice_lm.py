"""7. LM scoring: the probability of a document summed over all its subword segmentations.

A word, with a white-space mark before it, is a lattice: every piece of an existing vocabulary that matches at a place
is an arc (bytes stand in for any character), weighted by the piece's unigram log probability; a training word also
has one arc of its own, weighted by its discounted count. A forward recursion in log space gives the word's marginal
probability over the subword arcs, to which its own arc is added; a document's is the product over its words and one
end. Pieces and first weights (a rank law over the vocabulary's scores) come from the vocabulary file; expected piece
counts over all distinct training words (forward-backward, ``rounds`` times) then set the weights. What the own arcs give up (absolute discounting) is the weight of the subword arcs.

Word counts, N and V are exact and made by Spark; the most frequent words are broadcast up to a bound, the others are
joined by shuffles.

Cases: a null or empty text has the end only; with no training rows all counts are 0 and the first weights stand;
each row is scored by its own number, so rows that repeat a doc_id or have none get what their texts give; an empty
table gives an empty result; other columns are ignored; whole texts are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, Recent, crc_mod, slices, without_gc, words_of, written

MARK = "▁"
LOG10 = math.log(10)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The most frequent training words that are broadcast with their counts.
FREQUENT = 100_000
END = "\n"  # no word holds a line feed


class Lattice:
    """Pieces as prefixes of each other, each with a number and a log probability, or None for a prefix that is no piece."""

    def __init__(self, arcs: dict[str, tuple[int, float] | None], byte_arcs: list[tuple[int, float]]):
        self.arcs, self.byte_arcs = arcs, byte_arcs
        self.weights = {p: x and x[1] for p, x in arcs.items()}
        self.spelled = Memo(lambda char: sum(byte_arcs[c][1] for c in char.encode("utf-8", "surrogatepass")), 50_000)
        whole = sorted((hashed(p), *x) for p, x in arcs.items() if x is not None)
        self.keys, self.logp = np.array([h for h, _, _ in whole], np.uint64), np.array([w for _, _, w in whole])
        self.numbers = np.array([i for _, i, _ in whole], np.int64)
        self.maybe = np.zeros(1 << 20, bool)  # by a key's highest bits: may it be a piece
        self.maybe[self.keys >> np.uint64(44)] = True
        self.longest = max((len(p) for p, x in arcs.items() if x is not None), default=1)
        self.log10 = Recent(150_000)

    @classmethod
    def of(cls, pieces: list[str], byte_at: list[int], logp: np.ndarray) -> Lattice:
        arcs: dict[str, tuple[int, float] | None] = {}
        for i, p in enumerate(pieces):
            for n in range(1, len(p)):
                arcs.setdefault(p[:n], None)
            if p:
                arcs[p] = i, float(logp[i])
        return cls(arcs, [(i, float(logp[i])) for i in byte_at])

    def edges(self, s: str) -> Iterator[tuple[int, int, tuple[int, ...], float]]:
        """(start, end, pieces, log probability), by start."""
        arcs, n = self.arcs, len(s)
        for i in range(n):
            b = [self.byte_arcs[c] for c in s[i].encode("utf-8", "surrogatepass")]
            yield i, i + 1, tuple(x[0] for x in b), sum(x[1] for x in b)
            for j in range(i + 1, n + 1):
                part = s[i:j]
                if part not in arcs:
                    break
                if (arc := arcs[part]) is not None:
                    yield i, j, (arc[0],), arc[1]

    def forward(self, s: str) -> list[float]:
        """Log probability, summed over all segmentations, of each prefix of ``s``."""
        weights, spelled, n = self.weights, self.spelled, len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        alpha = [0.0] * (n + 1)
        for i in range(n):
            a = alpha[i] = log_sum(into[i])
            into[i + 1].append(a + spelled[s[i]])
            j = i + 1
            while j <= n and (part := s[i:j]) in weights:
                if (w := weights[part]) is not None:
                    into[j].append(a + w)
                j += 1
        alpha[n] = log_sum(into[n])
        return alpha

    def learn(self, words: set[bytes]) -> dict[bytes, float]:
        """log10 probabilities of words by their subword arcs; all of ``words`` are then in the memory returned."""
        self.log10.turn()
        need = sorted(self.log10.missing(words), key=len)
        shown = [MARK + w.decode("utf-8", "replace") for w in need]
        for i in range(0, len(need), 4096):
            self.log10.now.update(zip(need[i : i + 4096], self._together(shown[i : i + 4096]), strict=True))
        return self.log10.now

    def _together(self, words: list[str]) -> list[float]:
        """The forward recursion of many words at once, a row each; long ones alone."""
        if max(map(len, words)) > 64:
            return [self.forward(w)[-1] / LOG10 for w in words]
        n = np.fromiter(map(len, words), np.int64, len(words))
        weights = [w for w, _, _, _ in self._arcs(words, int(n.max()))[0]]
        alpha = forward_together(weights)
        return (alpha[np.arange(len(words)), n] / LOG10).tolist()

    def _arcs(self, words: list[str], width: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each arc length the weights by word and start, and row, start and key of the arcs that are pieces;
        then the log probabilities of characters by bytes, the distinct characters and where they stand."""
        points = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), width)
        chars, at = np.unique(points, return_inverse=True)
        at = at.reshape(points.shape)
        spelled = np.array([self.spelled[chr(c)] for c in chars.tolist()])[at]
        arcs, h = [], np.zeros(points.shape, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, min(self.longest, width) + 1):
                h = h[:, : width - k + 1] * FACTOR + (points[:, k - 1 :] + np.uint32(1))
                row, start = np.nonzero(self.maybe[h >> np.uint64(44)])
                sought = h[row, start]
                i = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
                same = self.keys[i] == sought
                row, start, i = row[same], start[same], i[same]
                w = spelled.copy() if k == 1 else np.full(h.shape, -np.inf)
                w[row, start] = np.logaddexp(w[row, start], self.logp[i])
                arcs.append((w, row, start, i))
        return arcs, spelled, chars, at

    def add_expected(self, words: list[str], total: np.ndarray) -> None:
        """Add the expected numbers of pieces of all ``words`` to ``total``: those of one length together, long ones alone."""
        sizes: dict[int, list[str]] = {}
        for w in words:
            sizes.setdefault(len(w), []).append(w)
        for n, same in sizes.items():
            if n > 64:
                for w in same:
                    for i, p in self.expected(w):
                        total[i] += p
            else:
                for i in range(0, len(same), 4096):
                    self._add_together(same[i : i + 4096], n, total)

    def _add_together(self, words: list[str], n: int, total: np.ndarray) -> None:
        """Forward and backward recursion of words of ``n`` characters."""
        arcs, spelled, chars, at = self._arcs(words, n)
        weights = [w for w, _, _, _ in arcs]
        alpha = forward_together(weights)
        beta = forward_together([w[:, ::-1] for w in weights])[:, ::-1]
        end = alpha[:, n]
        for k, (_, row, start, i) in enumerate(arcs, 1):
            p = np.exp(alpha[row, start] + self.logp[i] + beta[row, start + k] - end[row])
            total += np.bincount(self.numbers[i], p, len(total))
        by_char = np.bincount(at.ravel(), np.exp(alpha[:, :n] + spelled + beta[:, 1:] - end[:, None]).ravel(), len(chars))
        for c, p in zip(chars.tolist(), by_char.tolist(), strict=True):
            for b in chr(c).encode("utf-8", "surrogatepass"):
                total[self.byte_arcs[b][0]] += p

    def expected(self, s: str) -> Iterator[tuple[int, float]]:
        """Expected numbers of pieces over all segmentations of ``s``."""
        edges = list(self.edges(s))
        alpha, n = self.forward(s), len(s)
        out: list[list[float]] = [[] for _ in range(n + 1)]
        out[n].append(0.0)
        beta, at = [0.0] * (n + 1), n + 1
        for i, j, _, w in reversed(edges):
            if j != at and not beta[j]:
                beta[j] = log_sum(out[j])
            out[i].append(w + beta[j])
        for i, j, pieces, w in edges:
            p = math.exp(alpha[i] + w + beta[j] - alpha[n])
            for x in pieces:
                yield x, p


def hashed(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(FACTOR) + ord(c) + 1) % (1 << 64)
    return h


def forward_together(weights: list[np.ndarray]) -> np.ndarray:
    """Log probabilities of the prefixes of many words at once; ``weights``: for each arc length by word and start."""
    rows, width = weights[0].shape
    alpha = np.zeros((rows, width + 1))
    for j in range(1, width + 1):
        into = np.stack([alpha[:, j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)])
        top = into.max(0)
        alpha[:, j] = top + np.log(np.exp(into - top).sum(0))
    return alpha


def log_sum(xs: list[float]) -> float:
    if len(xs) == 1:
        return xs[0]
    m = max(xs)
    return m + math.log(sum([math.exp(x - m) for x in xs]))


def vocabulary(model_file: str) -> tuple[list[str], list[int], np.ndarray]:
    """Pieces (lower-case text has no use for others, which stay as they are), byte pieces, and first log weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    pieces = [sp.id_to_piece(i) if usable[i] and not sp.is_byte(i) else "" for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
    weight = np.where(usable, 1 / (rank + 10.0), 0.0)
    with np.errstate(divide="ignore"):
        return pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.log(weight / weight.sum())


_lattices: dict[int, tuple[Fitted, Lattice]] = {}


def lattice_of(model: Fitted) -> Lattice:
    """The lattice with its memory, kept between the tasks of one worker that use the same model."""
    if id(model) not in _lattices:
        _lattices.clear()
        _lattices[id(model)] = model, Lattice(model.arcs, model.byte_arcs)
    return _lattices[id(model)][1]


def word_counts(docs: DataFrame, is_training: Column) -> DataFrame:
    """``word, c``: how often each word stands in the training texts, the end included; ``docs``: doc_id, text.

    Tasks count in memory and give out what they have when it gets large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[END.encode()] += 1
                if len(counts) > 300_000:
                    yield given()
        if counts:
            yield given()

    return docs.where(is_training).select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def expected_counts(counts: DataFrame, lattice: Lattice, n: int) -> np.ndarray:
    """Expected piece counts, each distinct word taken once; what reaches the driver has one row for each piece."""
    shared = counts.sparkSession.sparkContext.broadcast((lattice.arcs, lattice.byte_arcs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*shared.value)
        total = np.zeros(n)
        kept: list[str] = []
        for batch in batches:
            kept += [MARK + word for word in batch.column(0).to_pylist() if word != END]
            if len(kept) > 20_000:
                own.add_expected(kept, total)
                kept = []
        own.add_expected(kept, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

    out = np.zeros(n)
    for r in counts.select("word").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


@dataclass
class Fitted:
    """What the tasks need: the lattice's arcs, totals, counts of frequent words, and the word arcs' discount."""

    arcs: dict
    byte_arcs: list
    total: int
    distinct: int
    frequent: dict[bytes, int]
    discount: float
    rest: float  # log10 of the probability that a token is spelled by subword arcs


def fit(counts: DataFrame, model_file: str, rounds: int = 3, most_frequent: int = FREQUENT) -> Fitted:
    """``counts``: a written table of training word counts."""
    pieces, byte_at, logp = vocabulary(model_file)
    total, distinct, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    steps = counts.agg(*[F.count_if(F.col("c") >= 1 << k).alias(f"k{k}") for k in range(50)]).first()
    least = next(1 << k for k in range(50) if steps[k] <= most_frequent)
    frequent = {r.word.encode(): r.c for r in counts.where(F.col("c") >= least).collect()}
    discount = (once + 1) / (once + 2 * twice + 2)
    if total:
        for _ in range(rounds):
            n = expected_counts(counts, Lattice.of(pieces, byte_at, logp), len(pieces))
            n = np.where(np.isfinite(logp), n + 0.01, 0)
            with np.errstate(divide="ignore"):
                logp = np.log(n / n.sum())
    lattice = Lattice.of(pieces, byte_at, logp)
    return Fitted(lattice.arcs, lattice.byte_arcs, total, distinct, frequent, discount, math.log10((discount * distinct + 1) / (total + 1)))


def scored(docs: DataFrame, counts: DataFrame, model: Fitted) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; ``counts``: the table the model was fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    denominator = model.total + 0.1 * (model.distinct + 1)
    discount, total, spelled = model.discount, model.total, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lattice, get, end = lattice_of(m), m.frequent.get, END.encode()
        row = TaskContext.get().partitionId() << 40
        with without_gc():
            for batch in slices(batches):
                texts = [[*words_of(t), end] for t in batch.column(1).to_pylist()]
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                kinds = set().union(*texts)
                log10 = lattice.learn(kinds)
                kinds = list(kinds)
                c = np.array([get(w, -1) for w in kinds], np.float64)
                spelled = np.array([-np.inf if w == end else log10[w] for w in kinds])  # the end has its own arc only
                known = c >= 0
                # log10 of a frequent word's base and marginal probabilities; the others' are summed up after the join
                base = np.where(known, np.log10((np.maximum(c, 0) + 0.1) / denominator), 0.0)
                sub = np.where(np.isfinite(spelled), 10 ** np.maximum(-300.0, m.rest + spelled), 0.0)
                score = np.where(known, np.log10(np.maximum(np.maximum(c - m.discount, 0) / (m.total + 1) + sub, 5e-324)), 0.0)
                index = dict(zip(kinds, range(len(kinds)), strict=True))
                where = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, n.sum())
                starts = np.cumsum(n) - n
                sums = [np.add.reduceat(x[where], starts) for x in (known.astype(np.int64), base, score)]
                rare = ~known[where]
                met, times = np.unique(np.repeat(np.arange(len(texts)), n)[rare] * len(kinds) + where[rare], return_counts=True)
                kind = met % len(kinds)
                words = pa.array([kinds[i].decode("utf-8", "replace") for i in kind.tolist()], pa.string())
                each = pa.StructArray.from_arrays([words, pa.array(times, pa.int64()), pa.array(spelled[kind])], ["word", "n", "l"])
                cuts = np.searchsorted(met, np.arange(len(texts) + 1) * len(kinds))
                more = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)
                columns = [pa.array(np.arange(row, row + len(texts))), batch.column(0), pa.array(n), *map(pa.array, sums), more]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "score", "rare"])

    first = written(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double, rare array<struct<word: string, n: bigint, l: double>>"), "scored")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n", "r.l").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    spelling = F.col("l") + spelled
    arc = F.when(c > 0, F.log10((c - discount) / (total + 1) + F.pow(F.lit(10.0), F.greatest(spelling, F.lit(-300.0))))).otherwise(spelling)
    # the end is rare only where nothing was learned
    arc = F.when((F.col("word") == END) & (c == 0), F.lit(-1.0)).otherwise(arc)
    parts = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((c + 0.1) / denominator)).alias("rest"), F.sum(F.col("n") * arc).alias("sub"))
    joined = first.drop("rare").join(parts, "row", "left")
    return joined.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("sub", F.lit(0.0))).alias("score"))


def lm_report(docs: DataFrame, model_file: str) -> DataFrame:
    """Scores of all texts with a ``held_out`` column; learned from rows whose crc32(doc_id) mod 10 isn't 0."""
    held = crc_mod("doc_id", 10) == 0
    counts = written(word_counts(docs.select("doc_id", "text"), ~held), "counts")
    out = scored(docs, counts, fit(counts, model_file))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
