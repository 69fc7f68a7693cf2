"""10. Toxicity: multiple-instance learning, sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences (cut after ``. ! ?`` and line feeds). A sentence's evidence is a sum of weights of
hashed byte n-grams (4 to 6, inside words, each once), none negative. Its score is the rise of a logistic function over
its value without evidence, so a sentence that holds none of the n-grams scores 0 and length alone convicts nobody.
Only n-grams that prefer toxic documents in the bounded labelled sample (``per_class`` rows of each class) carry a
weight. Weights are fitted to document labels by leaky noisy-or, 1 - (1 - leak) prod(1 - sentence score), where the
leak takes what no sentence explains. Sentences that score half or more offend, and are located; a document's score is
1 - prod(1 - sentence score) over the offending ones, or else its highest sentence score.

Cases: a null or empty text has no sentence and scores 0; without labelled rows of both classes every score is 0;
repeated rows get repeated results; conflicting labels of a document count as toxic; of rows that repeat a doc_id one is
learned; an empty table gives an empty result; other columns are ignored, but for ``clean``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, ngram_buckets, slices, smallest_hashes

BITS = 18
ORDERS = (4, 5, 6)
#: Of a sentence's score without evidence, as a logit: a sentence offends by strong evidence only.
HIGHEST_BIAS = -5.0
_SPACE = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and scores of a text's sentences (of the text with A-Z lower-cased)."""
        sid, h, starts, ends = features(text)
        w = self.weights[h]
        at = np.flatnonzero(w)
        of, kind = np.unique(np.stack([sid(at), h[at].astype(np.int64)]), axis=1)  # an n-gram counts once in a sentence
        z = np.bincount(of, weights=self.weights[kind], minlength=len(starts)) if len(starts) else np.zeros(0)
        return starts, ends, risen(z, self.bias)

    def score(self, text: str | None) -> tuple[float, int]:
        """The document's score and the number of offending sentences."""
        p = self.sentences(text)[2]
        hit = p[p >= 0.5]
        if len(hit):
            return float(-np.expm1(np.log1p(-np.minimum(hit, 1 - 1e-12)).sum())), len(hit)
        return float(p.max(initial=0.0)), 0

    def offending(self, text: str | None) -> list[str]:
        starts, ends, p = self.sentences(text)
        data = (text or "").encode("utf-8", "surrogatepass")
        return [data[a:b].decode("utf-8", "replace").strip() for a, b, x in zip(starts, ends, p, strict=True) if x >= 0.5]


def risen(evidence: np.ndarray, bias: float) -> np.ndarray:
    """(s(bias + evidence) - s(bias)) / (1 - s(bias)) of the logistic function s: 0 without evidence, up to 1."""
    return np.maximum(-np.expm1(np.logaddexp(0, bias) - np.logaddexp(0, bias + evidence)), 0.0)


def features(text: str | None):
    """A function from feature numbers to sentence numbers; buckets; byte starts and ends of the sentences."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if not raw.strip():
        return (lambda at: at), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b" " + raw.translate(_SPACE) + b" ", np.uint8)
    plain = np.frombuffer(raw, np.uint8)
    stops = np.flatnonzero((plain == 46) | (plain == 33) | (plain == 63) | (plain == 10)) + 1
    starts = np.concatenate([[0], stops])
    ends = np.concatenate([stops, [len(raw)]])
    found = [ngram_buckets(data, n, BITS) for n in ORDERS]
    places = np.concatenate([x[0] for x in found])
    # a place in data is one more than in the text; an n-gram belongs to the sentence of its second byte
    return (lambda at: np.searchsorted(stops, places[at], side="right")), np.concatenate([x[1] for x in found]), starts, ends


def train(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.2, decay: float = 3e-5) -> ToxicityModel:
    """Fit on (text, 0 or 1) pairs by gradient steps (Adam) on the leaky noisy-or likelihood."""
    weights = np.zeros(1 << BITS, np.float32)
    rows = sorted(set(rows))
    n = np.array([sum(y == c for _, y in rows) for c in (0, 1)])
    if not n.all():
        return ToxicityModel(weights, -1000.0)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for text, y in rows:
        seen[y, np.unique(features(text)[1])] += 1
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    used = np.flatnonzero((odds > 1.5) & (seen[1] >= 3))
    column = np.full(1 << BITS, -1, np.int64)
    column[used] = np.arange(len(used))
    at, col, base, bag_of = [], [], 0, []
    # read again, as all n-grams of all texts are too many to keep
    for i, (text, _) in enumerate(rows):
        sid, h, starts, _ = features(text)
        place = np.flatnonzero(column[h] >= 0)
        pairs = np.unique(np.stack([sid(place), column[h[place]]]), axis=1)
        at.append(pairs[0] + base)
        col.append(pairs[1])
        bag_of.append(np.full(len(starts), i))
        base += len(starts)
    at, col, bag_of = np.concatenate(at), np.concatenate(col), np.concatenate(bag_of)
    y = np.array([y for _, y in rows], float)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    theta = np.concatenate([np.clip(odds[used], 0, 4) * 0.5, [-6.0, -4.0]])  # weights, bias, leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, rounds + 1):
        bias, leak = theta[-2:]
        z = np.bincount(at, weights=theta[:-2][col], minlength=base)
        p = sigmoid(bias + z)
        # log of (1 - leak) prod(1 - sentence score)
        clean = np.bincount(bag_of, weights=np.logaddexp(0, bias) - np.logaddexp(0, bias + z), minlength=len(rows)) - np.logaddexp(0, leak)
        doc = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(y == 1, -(1 - doc) / doc, 1.0) * share
        dz = p * pull[bag_of]
        rise = ((p - sigmoid(bias)) * pull[bag_of]).sum()
        g = np.concatenate([np.bincount(col, weights=dz[at], minlength=len(used)) + decay * theta[:-2], [rise, (sigmoid(leak) * pull).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:-2] = np.maximum(theta[:-2], 0)
        theta[-2] = min(theta[-2], HIGHEST_BIAS)
    weights[used] = theta[:-2]
    return ToxicityModel(weights, float(theta[-2]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows of ``docs``; rows with null labels are left out."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marks.groupBy("toxic").agg(F.count("*").alias("n"))
    ids = smallest_hashes(marks, "toxic", F.broadcast(counts), per_class).limit(2 * per_class)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return train([(r.text, r.toxic) for r in rows.select("text", "toxic").collect()])


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted, n_offending`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            out = [m.score(t) for t in batch.column(1).to_pylist()]
            score = pa.array([x[0] for x in out], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score, pa.array([int(x[0] >= 0.5) for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], ["doc_id", "score", "predicted", "n_offending"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int, n_offending bigint")


def located(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, sentences array<string>``: the offending sentences of texts that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([shared.value.offending(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "sentences"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, sentences array<string>").where("size(sentences) > 0")


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that score under one half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.score(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_offending``, learned from labels of rows that aren't held out."""
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs, labels.where(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_offending")
