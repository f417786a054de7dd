"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences and is toxic if any of its sentences is. A sentence's score is a
logistic function of its distinct word features; the document's is the noisy-or
1 - prod(1 - p_sentence), so a gradient of the document's label reaches the sentences in proportion
to what they add, and scores can be traced back to the sentences that cause them.

Features of a word: the word with A-Z lowered and outer punctuation taken off, and for words of over
4 characters their first 4 and first 5. Features in fewer than `least` training documents are left
out, and an L1 penalty leaves weights on few of them, so a model is a small table. A word's weight
depends on the word alone and is kept in a bounded cache.

Training takes at most `max_training` labelled documents (the documented bound; those with the
smallest hash of their id, so the sample does not depend on partitions); everything else, scoring
included, covers whole texts. Offending sentences are those whose own score reaches the threshold.
labels, lang, source and doc_id are no input of a score.

Defined cases: a null or empty text has no sentence, and scores 0; a null doc_id is no training
document and is scored; labels that are null or contradict each other are left out; with no usable
label, or one class only, every score is 0; each of repeated rows is scored; an empty table gives an
empty result; other columns are kept, but for score, predicted and sentences, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SENTENCE = re.compile(r"[.!?\n]+")
_OUTER = ".,;:!?\"'()[]{}<>|*#-_"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CACHED = 300_000


def word_features(word: str) -> tuple[str, ...]:
    w = word.strip(_OUTER)
    if not w:
        return ()
    return (w, f"^4{w[:4]}", f"^5{w[:5]}") if len(w) > 4 else (w,)


def sentences(text: str) -> list[list[str]]:
    return [w for s in _SENTENCE.split(text.translate(_LOWER)) if (w := s.split())]


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences() of a text, in the same order."""
    cuts = [(0, 0), *(m.span() for m in _SENTENCE.finditer(text)), (len(text), len(text))]
    return [(a, b) for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


class _WordWeights(dict):
    """The weight of any word, kept once it was asked for."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _CACHED:
            self.clear()
        x = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return x


class Model:
    """A bias and the weights of features; without a bias nothing was learnt and nothing is toxic."""

    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias = weights, bias
        self.words = _WordWeights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_scores(self, text: str) -> np.ndarray:
        """p of each sentence of a text, in order."""
        if self.bias is None:
            return np.zeros(0)
        get = self.words.__getitem__
        z = np.array([sum(map(get, dict.fromkeys(words))) for words in sentences(text)], float)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))

    def score(self, text: str | None) -> float:
        return noisy_or(self.sentence_scores(text or ""))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def fit(rows: list[tuple[str, int]], least: int = 3, epochs: int = 60, rate: float = 0.1, l1: float = 2e-4) -> Model:
    """Adam with soft thresholds on the noisy-or likelihood of the document labels."""
    kinds: dict[str, int] = {}
    seen: Counter[int] = Counter()
    feats, sent_of, doc_of = [], [], []
    known: dict[str, tuple[int, ...]] = {}
    for d, (text, _) in enumerate(rows):
        in_doc: set[int] = set()
        for words in sentences(text or ""):
            for w in dict.fromkeys(words):
                if w not in known:
                    known[w] = tuple(kinds.setdefault(f, len(kinds)) for f in word_features(w))
            got = set().union(*(known[w] for w in words))
            feats.append(np.fromiter(got, np.int32, len(got)))
            in_doc |= got
            doc_of.append(d)
        seen.update(in_doc)
    y = np.array([label for _, label in rows], float)
    doc_of = np.array(doc_of, np.int64)
    if len(set(y[np.unique(doc_of)].tolist())) < 2:
        return Model({}, None)
    n, sents = len(y), len(doc_of)
    sent_of = np.repeat(np.arange(sents), [len(f) for f in feats])
    feats = np.concatenate(feats)
    often = np.zeros(len(kinds), bool)
    often[[f for f, c in seen.items() if c >= least]] = True
    names = [f for f, ok in zip(kinds, often, strict=True) if ok]
    sent_of, feats = sent_of[often[feats]], (np.cumsum(often) - 1)[feats[often[feats]]]
    w, b = np.zeros(len(names)), -5.0
    m1, m2, n1, n2 = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.clip(b + np.bincount(sent_of, w[feats], sents), -30, 30)
        log_not = np.bincount(doc_of, -np.logaddexp(0, z), n)  # log of prod(1 - p)
        # the loss falls with each p of a toxic document by (1 - q) / q, and rises with those of clean ones
        pull = np.where(y == 1, -np.exp(log_not) / np.maximum(-np.expm1(log_not), 1e-9), 1.0) / n
        g = pull[doc_of] / (1 + np.exp(-z))
        grad, grad_b = np.bincount(feats, g[sent_of], len(w)), g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        n1, n2 = 0.9 * n1 + 0.1 * grad_b, 0.99 * n2 + 0.01 * grad_b**2
        step = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-5)
        w -= step * m1 / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * (n1 / (1 - 0.9**t)) / (np.sqrt(n2 / (1 - 0.99**t)) + 1e-5)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


def train(docs: DataFrame, labels: DataFrame, max_training: int = 4000, label: str = "toxic") -> Model:
    """Fits on at most max_training labelled documents outside the held-out part: those with the smallest hash of their
    id. Of rows that repeat an id, the smallest text counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("y")).where("low = y")
    one = one.where(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "y")
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)  # its size is the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return fit([(r["text"], r["y"]) for r in rows.orderBy("doc_id").select("text", "y").toLocalIterator()])


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.3, with_sentences: bool = False) -> DataFrame:
    """The rows of docs with score and predicted (and sentences: those at or over the threshold, by number among the
    document's sentences, with start and end in characters and score). Columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            m = shared.value
            score, found = [], []
            for t in batch.column(at):
                text = t.as_py()
                p = m.sentence_scores(text or "")
                score.append(noisy_or(p))
                if with_sentences:
                    bad = np.flatnonzero(p >= threshold).tolist()
                    at_text = spans(text) if bad else []
                    found.append([{"number": i, "start": at_text[i][0], "end": at_text[i][1], "score": float(p[i])} for i in bad])
            new = [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]
            if with_sentences:
                new.append(pa.array(found, pa.list_(pa.struct([("number", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "predicted", *["sentences"] * with_sentences])

    kept = docs.drop("score", "predicted", "sentences")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", score double, predicted int" + ", sentences array<struct<number:int,start:bigint,end:bigint,score:double>>" * with_sentences
    return kept.mapInArrow(fn, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity_scores(docs.select("doc_id", "text"), model, with_sentences=True)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "sentences")
