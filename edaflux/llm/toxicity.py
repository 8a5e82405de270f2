"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whatever their labels say, is the unlabelled side. With the class prior p, the risk of the negatives is that of the unlabelled texts less p
times that of the positives taken as negatives; where an estimate falls below zero the model has begun to memorise, and
the step goes against that term (the non-negative correction). The model is linear in which words and word beginnings a
text holds. Features are those that positives hold more often than unlabelled texts, by a two-sample statistic of at
least ``CONTRAST`` standard errors, and the ``FEATURES`` of the largest statistic at most.

The numbers of sampled texts are parameters. All statistics of the sample are exact, and every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.llm.frames import fresh

POSITIVES = 2_500
UNLABELLED = 6_000
MIN_TEXTS = 5
FEATURES = 2_000
CONTRAST = 4.0
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, and the beginnings of 4 to 6 letters of the longer ones."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Classifier:
    """Word weights of a linear model; the score of a text is the logistic of the sum over its distinct words."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get, known = self.weights.get, self.weights.keys()
        total = np.array([sum(map(get, known & words_in(t)), self.bias) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def without_copies(texts: list[np.ndarray], codes: np.ndarray, bands: int = 4, rows: int = 4) -> list[np.ndarray]:
    """The first of each group of near copies (by banded min-hashes), so that a copied text counts once as evidence."""
    seen: set[tuple] = set()
    salts = np.random.default_rng(5).integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
    out = []
    for held in texts:
        if not len(held):
            continue
        least = ((codes[held][:, None] * salts) >> np.uint64(20)).min(0).tolist()
        keys = [(k, *least[k * rows : (k + 1) * rows]) for k in range(bands)]
        if not any(k in seen for k in keys):
            out.append(held)
        seen.update(keys)
    return out


def train(positives: list[str], unlabelled: list[str], prior: float, steps: int = 600, penalty: float = 1e-3) -> Classifier:
    """Weights that minimise the non-negative risk of the logistic loss plus ``penalty`` times their absolute values.

    Whole-batch proximal gradient steps with momentum; a word whose evidence is below the penalty weighs nothing.
    Without positives the score is constant and low.
    """
    number: dict[str, int] = {}
    encoded = [
        [np.array([number.setdefault(w, len(number)) for w in words_in(t)], np.int64) for t in texts]
        for texts in (positives, unlabelled)
    ]
    codes = np.fromiter((crc32(w.encode()) for w in number), np.uint64, len(number)) + np.uint64(1)
    pos, unl = (without_copies(texts, codes) for texts in encoded)
    if not pos or not unl:
        return Classifier({}, -2.0)
    in_pos, in_unl = (np.bincount(np.concatenate(texts), minlength=len(number)) for texts in (pos, unl))
    share = (in_pos + in_unl) / (len(pos) + len(unl))
    error = np.sqrt(share * (1 - share) * (1 / len(pos) + 1 / len(unl)))
    contrast = (in_pos / len(pos) - in_unl / len(unl)) / np.maximum(error, 1e-9)
    enough = (in_pos >= min(MIN_TEXTS, max(1, len(pos) // 20))) & (contrast >= CONTRAST)
    names = np.array(list(number), object)
    chosen = sorted(np.flatnonzero(enough).tolist(), key=lambda i: (-contrast[i], names[i]))[:FEATURES]
    if not chosen:
        return Classifier({}, -2.0)
    chosen = np.array(sorted(chosen, key=lambda i: names[i]))
    weights, bias = _minimise(pos, unl, chosen, prior, steps, penalty)
    chosen = chosen[weights != 0]
    if len(chosen):  # the penalty chose the words; their weights are fitted again almost without it
        weights, bias = _minimise(pos, unl, chosen, prior, steps, penalty / 100)
    return Classifier(dict(zip(names[chosen].tolist(), weights.tolist(), strict=True)) if len(chosen) else {}, bias)


def _columns(texts: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the chosen words that each text holds."""
    place = np.full(int(max(chosen.max(), max(int(t.max()) for t in texts))) + 1, -1)
    place[chosen] = np.arange(len(chosen))
    row, column = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), place[np.concatenate(texts)]
    return row[column >= 0], column[column >= 0]


def _minimise(pos: list, unl: list, words: np.ndarray, prior: float, steps: int, penalty: float) -> tuple[np.ndarray, float]:
    (pr, pc), (ur, uc) = _columns(pos, words), _columns(unl, words)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    spread = np.ones(len(words))
    for _ in range(20):  # largest eigenvalue of the weighted second moments, for the step size
        spread /= np.linalg.norm(spread)
        a, c = np.bincount(pr, spread[pc], len(pos)) / len(pos), np.bincount(ur, spread[uc], len(unl)) / len(unl)
        spread = prior * np.bincount(pc, a[pr], len(words)) + np.bincount(uc, c[ur], len(words))
    step = 1 / (0.25 * (np.linalg.norm(spread) + 1) + 1e-9)
    w, b = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(steps):
        zp = np.bincount(pr, w_ahead[pc], len(pos)) + b_ahead
        zu = np.bincount(ur, w_ahead[uc], len(unl)) + b_ahead
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Gradients of the losses by score: -(1 - s) as a positive, s as a negative.
        if negative >= 0:
            gp, gu = np.full(len(pos), -prior / len(pos)), su / len(unl)
        else:
            gp, gu = prior * sp / len(pos), -su / len(unl)
        grad = np.bincount(pc, gp[pr], len(words)) + np.bincount(uc, gu[ur], len(words))
        moved = w_ahead - step * grad
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), b_ahead - step * (gp.sum() + gu.sum())
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w_ahead, b_ahead = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null keys count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Classifier:
    """Train on a bounded sample: texts labelled toxic, and any texts as the unlabelled, both outside the held-out fold.

    Samples, and so what the driver holds, are bounded: the rows with the smallest key hashes, ``positives`` and ``unlabelled`` of them in expectation. The prior is the share of toxic among the labelled rows outside
    the held-out fold. A document labelled twice counts as toxic if any label says so; null labels say nothing.
    """
    marked = labels.where((fold(F.col(key)) != 0) & F.col(key).isNotNull() & F.col(toxic).isNotNull())
    marked = marked.groupBy(F.col(key).alias("k")).agg((F.max(toxic) == 1).alias("toxic"))
    counts = marked.agg(F.count("*"), F.count_if("toxic")).head()
    if not counts[1]:
        return train([], [], 0.5)
    prior = min(max(counts[1] / counts[0], 0.01), 0.9)
    rate = lambda wanted, there: F.lit(min(1.0, wanted / max(there, 1)))
    place = F.pmod(F.xxhash64(F.col("k"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    some = marked.where("toxic").where(place < rate(positives, counts[1])).select("k")
    pos = plain.join(F.broadcast(some), "k", "left_semi").collect()  # at most about ``positives`` rows
    # Drawn from the whole population, whatever the labels say, so that toxic texts have their share.
    unl = plain.where((fold(F.col("k")) != 0) & (place < rate(unlabelled, docs.count()))).collect()
    return train([r["t"] for r in sorted(pos)], [r["t"] for r in sorted(unl)], prior)


def score(model: Classifier, text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return F.arrow_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **sample: int) -> DataFrame:
    """Rows (key, held_out, score, predicted), one for each input row; every text is scored whole.

    Null and empty texts score as the bias alone. Rows with null keys are scored and never learnt from; repeated rows
    stay. Without labels every score is the same and below one half.
    """
    model = fit(docs, labels, key, text, **sample)
    scored = docs.select(F.col(key), (fold(F.col(key)) == 0).alias("held_out"), score(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **sample: int) -> DataFrame:
    """``docs`` less those that the model takes for toxic; columns as they were."""
    model = fit(docs, labels, key, text, **sample)
    name = fresh(docs, "_score")
    return docs.withColumn(name, score(model, F.col(text))).where(F.col(name) < 0.5).drop(name)
