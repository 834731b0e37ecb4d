"""Document quality by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives and unlabelled web text are described by statistics of their form (case,
symbols, repetition of words, word pairs and lines). An additive model over piecewise linear
functions of these minimises ``prior * risk(positives as 1) + max(0, risk(unlabelled as 0) -
prior * risk(positives as 0))`` with logistic losses, so that its output estimates the
probability of class 1. Negatives are never used. The class prior is estimated from positives and unlabelled text alone: a classifier of
positives against unlabelled text is fitted on half of both; on the other half the prior is the least ratio, over score thresholds, of the shares
of unlabelled text and of positives above it, with confidence bounds for small shares (best-bin estimation, Garg et al. 2021).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches

MARKS = re.compile(r"[^\w\s]{2,}")
ALNUM = re.compile(r"[^\W_]")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text's form, each of about the size of 1."""
    text = text or ""
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower, digits = data[65:91].sum(), data[97:123].sum(), data[48:58].sum()
    spaces = data[32] + data[9:14].sum()
    chars = max(1, data.sum() - spaces)
    other = data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count, seen = Counter(words), Counter(lines)
    pairs = len(set(zip(words, words[1:])))
    repeated = sum(len(k) * v for k, v in seen.items() if v > 1)
    return [
        upper / max(1, upper + lower),
        digits / chars,
        other / chars,
        len(MARKS.findall(text)) / n,
        sum(v for k, v in count.items() if not ALNUM.search(k)) / n,
        len(count) / n,
        max(count.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        pairs / max(1, n - 1),
        len(seen) / max(1, len(lines)),
        repeated / max(1, len(text)),
        np.log1p(len(words)) / 10,
        (chars / n) / 10,
        len(lines) / n,
        (data[46] + data[44]) / n,
        data[128:].sum() / chars,
        len(count) / n * np.log1p(n) / 7,
        max((len(w) for w in count), default=0) / 100,
    ]


@dataclass(frozen=True)
class QualityModel:
    knots: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(hinges(x, self.knots) @ self.weights + self.bias, -30, 30)))


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature, and its excess over each of its knots in units of their spread."""
    x = np.asarray(x, float).reshape(-1, knots.shape[1])
    spread = np.maximum(knots[-1] - knots[0], 0.02)
    parts = [np.clip((x - k) / spread, 0, 2) for k in knots]
    return np.concatenate(parts, axis=1)


def risks(p: np.ndarray, u: np.ndarray, w: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk of positives as class 1, the corrected risk of class 0, and the gradient (weights, then bias) of the step to take.

    While the corrected risk is not negative that is the gradient of their sum, else that of the corrected risk's negative.
    """
    sp = 1 / (1 + np.exp(-np.clip(p @ w + bias, -30, 30)))
    su = 1 / (1 + np.exp(-np.clip(u @ w + bias, -30, 30)))
    positive = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
    as_one, as_zero, unlabelled = (sp - 1) / len(p), sp / len(p), su / len(u)
    gp, gu = (prior * (as_one - as_zero), unlabelled) if negative >= 0 else (prior * as_zero, -unlabelled)
    return float(positive), float(negative), np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())


def fit_non_negative(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, penalty: float = 1e-4) -> QualityModel:
    both = np.concatenate([positives, unlabelled])
    knots = np.quantile(both, [0, 0.02, 0.1, 0.3, 0.6, 0.85, 0.95, 0.99], axis=0)
    p, u = hinges(positives, knots), hinges(unlabelled, knots)
    w, bias = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = risks(p, u, w, bias, prior)[2]
        g[:-1] += penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return QualityModel(knots, w, bias)


def fit_logistic(ones: np.ndarray, zeros: np.ndarray, steps: int = 300, rate: float = 0.05, penalty: float = 1e-3) -> QualityModel:
    """Logistic regression of two classes of equal weight, over the same functions."""
    knots = np.quantile(np.concatenate([ones, zeros]), [0, 0.02, 0.1, 0.3, 0.6, 0.85, 0.95, 0.99], axis=0)
    x = hinges(np.concatenate([ones, zeros]), knots)
    y = np.repeat([1.0, 0.0], [len(ones), len(zeros)])
    share = np.where(y == 1, 0.5 / len(ones), 0.5 / len(zeros))
    w, bias = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y) * share
        g = np.append(x.T @ g + penalty * w, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return QualityModel(knots, w, bias)


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, failure: float = 0.1, slack: float = 0.01) -> float:
    """Share of class 1 in the unlabelled rows: the ratio of the shares of both samples above the threshold whose bound is least."""
    if min(len(positives), len(unlabelled)) < 4:
        return 0.5
    model = fit_logistic(positives[::2], unlabelled[::2])
    p, u = np.sort(model.score(positives[1::2])), np.sort(model.score(unlabelled[1::2]))
    cuts = np.unique(p)
    share_p = 1 - np.searchsorted(p, cuts) / len(p)
    share_u = 1 - np.searchsorted(u, cuts) / len(u)
    doubt = np.sqrt(np.log(4 / failure) / 2 / len(u)) + np.sqrt(np.log(4 / failure) / 2 / len(p))
    best = np.argmin((share_u + (1 + slack) * doubt) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])


def crc_of(id_col: Column, modulus: int) -> Column:
    """The CRC-32 of an id's text, modulo ``modulus``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def first_by_hash(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes of their ids, all if there are fewer; ties of a hash go to the smaller id.

    Rows are counted by range of their hash first, so that only those of the lowest ranges, not many more than ``n``, are ordered in one task.
    """
    ranges = 1 << 12
    place = F.floor((F.xxhash64(id_col).cast("double") / 2.0**64 + 0.5) * ranges)
    upto, last = 0, ranges
    for row in df.groupBy(place.alias("range")).count().orderBy("range").collect():  # at most ranges + 1 rows
        upto += row["count"]
        if upto >= n:
            last = row["range"]
            break
    return df.where(place <= last).orderBy(F.xxhash64(id_col), id_col).limit(n)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 8000, unlabelled: int = 16000, prior: float | None = None) -> QualityModel | None:
    """Fit on at most ``positives`` documents of label 1 and ``unlabelled`` documents of any kind.

    Which they are follows from a hash of the ids. ``labels`` should hold the training rows only; null labels and
    labels without a document take no part, nor does any other label than 1. Rows of one id are one document of the sample, with the smallest of their texts. ``prior`` is the share of class 1 among all documents, estimated if not
    given. Without labels of class 1 or without documents there is no model.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).dropna().distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = first_by_hash(known, "id", positives).withColumn("positive", F.lit(True)).union(
        first_by_hash(texts.select("id").where("id IS NOT NULL").distinct(), "id", unlabelled).withColumn("positive", F.lit(False))
    )
    # at most positives + unlabelled ids, and one row of each
    sampled = texts.join(F.broadcast(chosen), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    sample = append_columns(sampled, "text", FEATURES, _maker).select("positive", "features", "id").toPandas().sort_values("id", kind="stable")
    if sample.empty:
        return None
    x = np.array(sample["features"].tolist(), float).reshape(len(sample), -1)
    mask = sample["positive"].to_numpy(bool)
    if not mask.any() or mask.all():
        return None
    return fit_non_negative(x[mask], x[~mask], prior if prior is not None else estimate_prior(x[mask], x[~mask]))


def _maker():
    return lambda texts: [[features(t) for t in texts]]


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``: the estimated probability of class 1 of each whole text (null: empty); 0.5 without a model.

    Only the text is looked at. Repeated rows are scored each. A column named ``out`` is replaced.
    """
    small_batches(docs.sparkSession)

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts])).tolist() if model and texts else [0.5] * len(texts)]

    return append_columns(docs, text_col, T.StructType([T.StructField(out, T.DoubleType())]), make)
