"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence's score is logistic in weights of its distinct words and their first letters; a document is toxic
unless all its sentences are clean, ``1 - product(1 - sentence)``. The sentence scores then locate what is offensive.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches
from campaignlens.llm.quality import first_by_hash

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 20
#: Weighed words that a worker keeps between batches.
KEPT_WORDS = 200_000


def slots(word: str) -> tuple[int, ...]:
    """Places of a word's weights: the word, and its first four, five and six letters."""
    return tuple({zlib.crc32(x.encode()) % SLOTS for x in ("w" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) >= k))})


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text or "")]


class Weights(dict):
    """Total weight of each word."""

    def __init__(self, by_slot: dict[int, float]):
        self.by_slot = by_slot

    def __missing__(self, word: str) -> float:
        self[word] = found = sum(self.by_slot.get(s, 0.0) for s in slots(word))
        return found


@dataclass
class ToxicityModel:
    by_slot: dict[int, float]
    bias: float

    def scorer(self):
        weights = Weights(self.by_slot)

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            """Of a document, and of its sentences of 0.5 or more."""
            if len(weights) > KEPT_WORDS:
                weights.clear()
            low, logs, found = (text or "").lower(), 0.0, []
            same = len(low) == len(text or "")  # a few capitals have longer small forms
            for m in SENTENCE.finditer(low if same else text or ""):
                z = self.bias + sum(map(weights.__getitem__, set(WORD.findall(m[0] if same else m[0].lower()))))
                z = min(max(z, -30.0), 30.0)
                logs -= math.log1p(math.exp(z))
                if z >= 0:
                    found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
            return -math.expm1(logs), found

        return score


def noisy_or_step(place: np.ndarray, sentence: np.ndarray, doc: np.ndarray, w: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss of documents, each weighted by its ``share``, and its gradient in the weights and, last of ``w``, the bias.

    ``place`` holds the weights that sentence ``sentence`` sums, ``doc`` the document of each sentence.
    """
    z = np.clip(w[-1] + np.bincount(sentence, w[place], len(doc)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
    loss = -(share * np.where(labels == 1, np.log(np.maximum(1 - clean, 1e-12)), np.log(np.maximum(clean, 1e-300)))).sum()
    g = (np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * share)[doc] * p
    return float(loss), np.append(np.bincount(place, g[sentence], len(w) - 1), g.sum())


def fit_noisy_or(flats: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, steps: int = 150, rate: float = 0.15, bias: float = -5.0, penalty: float = 2e-3, least_surprise: float = 10.0) -> ToxicityModel:
    """``flats``: for each document the slots of its sentences one after another; ``sizes``: how many each sentence has."""
    # what makes a document toxic stands in toxic ones far more often than chance would have it
    ones, all_ = np.zeros(SLOTS), np.zeros(SLOTS)
    for flat, label in zip(flats, labels):
        own = np.unique(flat)
        all_[own] += 1
        ones[own] += label
    share = labels.mean()
    rate1 = ones / np.maximum(all_, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = 2 * (np.nan_to_num(ones * np.log(rate1 / share)) + np.nan_to_num((all_ - ones) * np.log((1 - rate1) / (1 - share))))
    used = np.flatnonzero((rate1 > share) & (surprise >= least_surprise))
    index = np.full(SLOTS, -1, np.int32)
    index[used] = np.arange(len(used))
    doc = np.repeat(np.arange(len(flats)), [len(x) for x in sizes])
    places, sentences_, before = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    for flat, own in zip(flats, sizes):
        at = index[flat]
        keep = at >= 0
        places.append(at[keep])
        sentences_.append(before + np.repeat(np.arange(len(own)), own)[keep])
        before += len(own)
    place, sentence = np.concatenate(places), np.concatenate(sentences_)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for step in range(1, steps + 1):
        grad = noisy_or_step(place, sentence, doc, w, labels, balance)[1]
        grad[:-1] += penalty * w[:-1] / max(1, len(used))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w[:-1] = np.maximum(w[:-1], 0)  # a word can't make a sentence clean
    return ToxicityModel({int(s): float(x) for s, x in zip(used, w) if x}, float(w[-1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, class_bytes: int = 16 << 20) -> ToxicityModel | None:
    """Fit on at most ``per_class`` labelled documents of each class, and of these on as many as have ``class_bytes`` of text together,
    in the order of a hash of their ids.

    What the driver gets is bounded by both. Every document of the sample is read whole. ``labels`` should hold the training rows only; null labels and labels without a document take no part. Without
    documents of both classes there is no model.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = first_by_hash(known.where("y = 1"), "id", per_class).union(first_by_hash(known.where("y = 0"), "id", per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # two rows of at most per_class sizes each
    upto = F.sum("n").over(Window.partitionBy("y").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, 0))
    sizes = texts.select("id", "y", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"), F.xxhash64("id").alias("h")).groupBy("id", "y", "h").agg(F.sum("n").alias("n"))
    fitting = sizes.withColumn("upto", upto).where(F.col("upto") - F.col("n") < class_bytes).where(F.col("n") <= class_bytes).select("id")
    texts = texts.join(F.broadcast(fitting), "id", "left_semi")

    def make():
        def apply(rows):
            flats, sizes = [], []
            for t in rows:
                own = [sorted({s for w in set(WORD.findall((t or "")[a:b].lower())) for s in slots(w)}) for a, b in sentences(t)]
                flats.append(np.array([s for x in own for s in x], "<i4").tobytes())
                sizes.append(np.array([len(x) for x in own], "<i4").tobytes())
            return [flats, sizes]

        return apply

    fields = T.StructType([T.StructField("flat", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
    rows = append_columns(texts, "text", fields, make).select("y", "flat", "sizes").collect()
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return fit_noisy_or([np.frombuffer(r.flat, "<i4") for r in rows], [np.frombuffer(r.sizes, "<i4") for r in rows], y)


SCORED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """Append ``score`` of each whole text (null: empty) and ``offending``: its sentences of score 0.5 or more (code points).

    Without a model every score is 0. Only the text is looked at. Columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer() if sent.value else lambda text: (0.0, [])

        def apply(texts):
            made = [score(t) for t in texts]
            return [[s for s, _ in made], [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in made]]

        return apply

    return append_columns(docs, text_col, SCORED, make)
