"""9. Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection.

A text's features are its byte n-grams (2 to 4) inside words, each with an embedding; their mean goes through a linear
softmax. As both steps are linear, a trained model is one table of logits per bucket. The training sample is bounded
(``per_language`` rows of each language, fewer where the languages are so many that there would be more than ``most``);
a fifth of its texts, with the parts cut from them, is held back to set the softmax temperature and the confidence
below which a text is rejected.

Cases: a text that is null, empty or without a letter (a character of Unicode category L) gets ``und`` with score 0 and
is rejected; the rows of other texts get the likeliest learned language. With no labelled rows every text is ``und``.
Whole texts are used; repeated rows get repeated results, and of rows that repeat a doc_id one is learned for each
language; an empty table gives an empty result; other columns are ignored, but for ``accepted``, which keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, ngram_buckets, slices, small, smallest_hashes, written

BITS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_ASCII = re.compile("[A-Za-z]")


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    least: float  # calibrated confidence below which a text is rejected

    def probabilities(self, text: str) -> np.ndarray:
        h = buckets(text)
        z = (self.logits[h].mean(0, dtype=np.float64) if len(h) else 0.0) + self.bias
        return softmax(z / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, and whether the prediction is accepted."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def buckets(text: str) -> np.ndarray:
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8)
    return np.concatenate([ngram_buckets(data, n, BITS)[1] for n in ORDERS])


def train(rows: list[tuple[str, str]], dims: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, reject: float = 0.0005) -> LanguageModel:
    """Fit on (text, language) pairs. ``reject``: the share of right held-back predictions that the threshold gives up."""
    rows = sorted({(t, lang) for t, lang in rows if t and has_letter(t)})
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    # equal texts of several languages are one document, so that no text is both learned and held back
    texts = {t: i for i, t in enumerate(sorted({t for t, _ in rows}))}
    groups = [texts[t] for t, _ in rows]
    examples, source = [], []
    for at, (text, lang) in enumerate(rows):
        words = text.split()
        cut = int(rng.integers(0, max(1, len(words) - 12)))
        for part in (text, " ".join(words[cut : cut + int(rng.integers(3, 12))])):
            h, n = np.unique(buckets(part), return_counts=True)
            if len(h):
                examples.append((h, (n / n.sum()).astype(np.float32), languages.index(lang)))
                source.append(groups[at])
    order = rng.permutation(len(examples))
    apart = np.isin(np.array(source)[order], rng.permutation(len(texts))[: len(texts) // 5])
    held, used = order[apart], order[~apart]
    e = rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32)
    w = rng.normal(0, 0.1, (dims, k)).astype(np.float32)
    b = np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            h, share, y = examples[i]
            x = share @ e[h]
            g = softmax(x @ w + b).astype(np.float32)
            g[y] -= 1
            back = w @ g
            w -= step * np.outer(x, g)
            b -= 0.1 * step * g
            e[h] -= step * 8 * share[:, None] * back
    table = e @ w
    z = np.array([examples[i][1] @ table[examples[i][0]] + b for i in (held if len(held) else order)])
    y = np.array([examples[i][2] for i in (held if len(held) else order)])

    def loss(t: float) -> float:
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.05, 4, 40), key=loss)
    p = np.array([softmax(x / temperature) for x in z])
    right = p.max(1)[p.argmax(1) == y]
    least = float(np.quantile(right, reject)) if len(right) else 1.0
    return LanguageModel(languages, table.astype(np.float32), b.astype(np.float64), float(temperature), least)


def fit(docs: DataFrame, per_language: int = 400, most: int = 100_000) -> LanguageModel:
    """Train on a bounded sample of ``docs`` (``doc_id, text, lang``): null languages and texts are left out.

    Passes over ids and languages count each language's ids and choose those of the smallest hashes; one fetches texts.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    counts = written(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "languages")
    known = max(1, counts.count())
    ids = smallest_hashes(labelled, "lang", small(counts), max(1, min(per_language, most // known)))
    rows = labelled.join(F.broadcast(ids.limit(max(most, known))), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return train([(r.text, r.lang) for r in rows.select("text", "lang").collect()])


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            out = [m.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose prediction isn't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([m.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``, learned from the rows that aren't held out."""
    held = crc_mod("doc_id", 4) == 2
    out = predicted(docs, fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
