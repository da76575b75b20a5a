"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; everything else is unlabelled web text. The model, one
hidden layer over counts and shares of a text, minimises the non-negative unbiased risk

    prior * E_positive[loss(g)] + max(0, E_unlabelled[loss(-g)] - prior * E_positive[loss(-g)])

with the logistic loss, so that its sigmoid estimates the probability of good quality. No negative label
enters the risk. The class prior is estimated from the labels that may be learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import OWN
from loomgrid.llm.samples import labelled, remainder, texts_of

#: Trusted positives and unlabelled rows that are learned from, at most.
POSITIVES = 6000
UNLABELLED = 12000
CUT = 0.3
HIDDEN = 24
EPOCHS = 60
_SIGNS = "%$#&*!?|~^=+<>{}[]()/\\@_.,;:-\"'"
_TAIL = re.compile(r"[^\w\s]{2,}(?:\s|$)")
_DIGITS = re.compile(r"\d")
_CAPITALS = re.compile(r"[A-Z]")


def features(text: str) -> list[float]:
    """Counts and shares of a whole text; an empty text has some too."""
    n, words, lines = len(text), text.split(), text.split("\n")
    w = max(len(words), 1)
    counts, low = Counter(words), Counter(x.lower() for x in lines if x.strip())
    upper = sum(v for k, v in counts.items() if k.isupper() and len(k) > 1)
    repeated = sum(map(str.__eq__, words, words[1:]))
    lengths = sum(map(len, words))
    top = counts.most_common(3)
    out = [math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), lengths / w, len(counts) / w, (top[0][1] if top else 0) / w, sum(c for _, c in top) / w, repeated / w, upper / w]
    out += [len(_TAIL.findall(text)) / w, len(_DIGITS.findall(text)) / max(n, 1), len(_CAPITALS.findall(text)) / max(n, 1)]
    out += [1 - len(low) / max(sum(low.values()), 1), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines), len(words) / len(lines), max(map(len, lines)) / max(n, 1)]
    out += [sum(v for k, v in counts.items() if len(k) > 20) / w, sum(c for k, c in counts.items() if len(k) <= 2) / w]
    out += [text.count(s) / w for s in _SIGNS]
    out += [text.count("http") / w, text.count("  ") / w, text.count("\ufffd") / max(n, 1), sum(c for k, c in counts.items() if not k.isascii()) / w]
    return out


@dataclass(frozen=True)
class Model:
    """Ranks within the training sample's quantiles and distances from its means as inputs, one hidden layer, one output."""

    cuts: np.ndarray
    layers: tuple[np.ndarray, ...]
    middle: np.ndarray | float = 0.0
    spread: np.ndarray | float = 1.0

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        ranks = np.stack([np.searchsorted(c, rows[:, k]) for k, c in enumerate(self.cuts)], axis=1) / self.cuts.shape[1]
        return np.concatenate((2 * ranks - 1, (rows != 0).astype(float), np.clip((rows - self.middle) / self.spread, -6, 6) / 2), axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.layers):
            return np.full(len(rows), self.cuts.reshape(-1)[0])
        a, b, c, d = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(self.inputs(rows) @ a + b) @ c + d, -30, 30)))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk of the outputs g, and what to descend by for each of them: where the estimate of the negatives' risk is below zero, its own negative gradient, as in non-negative PU learning."""
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    softplus = lambda g: np.logaddexp(0, g)
    n, m = len(positive), len(unlabelled)
    good = prior * softplus(-positive).mean()
    bad = softplus(unlabelled).mean() - prior * softplus(positive).mean()
    if bad >= 0:
        return good + bad, prior * (sigmoid(positive) - 1) / n - prior * sigmoid(positive) / n, sigmoid(unlabelled) / m
    return good, prior * sigmoid(positive) / n, -sigmoid(unlabelled) / m


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Model:
    """A model by Adam on batches of both samples; the mean of the weights of the last half of the steps."""
    both = np.concatenate((positive, unlabelled))
    model = Model(np.stack([np.quantile(both[:, k], np.linspace(0, 1, 34)[1:-1]) for k in range(both.shape[1])]), (), both.mean(0), both.std(0) + 1e-6)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    rng = np.random.default_rng(seed)
    layers = [rng.standard_normal((p.shape[1], hidden)) / np.sqrt(p.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.array(math.log(prior / (1 - prior)))]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    mean, taken = [np.zeros_like(x) for x in layers], 0
    batches = max(4, min(len(u), 2 * len(p)) // 512)
    steps = epochs * batches
    for step in range(1, steps + 1):
        if (step - 1) % batches == 0:
            split_p, split_u = (np.array_split(rng.permutation(len(x)), batches) for x in (p, u))
        xp, xu = (x[s[(step - 1) % batches]] if len(s[(step - 1) % batches]) else x for x, s in ((p, split_p), (u, split_u)))
        x = np.concatenate((xp, xu))
        h = np.tanh(x @ layers[0] + layers[1])
        g = h @ layers[2] + layers[3]
        _, dp, du = non_negative_risk(g[: len(xp)], g[len(xp) :], prior)
        dg = np.concatenate((dp, du))
        dh = np.outer(dg, layers[2]) * (1 - h * h)
        for k, grad in enumerate((x.T @ dh + 1e-4 * layers[0], dh.sum(0), h.T @ dg + 1e-4 * layers[2], np.array(dg.sum()))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            layers[k] = layers[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            taken += 1
            mean = [m + w for m, w in zip(mean, layers)]
    return Model(model.cuts, tuple(m / taken for m in mean), model.middle, model.spread)


def _rows(texts: DataFrame) -> np.ndarray:
    """The features of a bounded sample of texts, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["row"])

    found = [r["row"] for r in texts.select("text").mapInArrow(run, "row array<double>").collect()]
    return np.array(sorted(found)) if found else np.zeros((0, 0))


def train(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from at most ``positives`` trusted rows and ``unlabelled`` rows of ``docs``.

    The prior is the share of good ones among the labels that meet ``learns``, kept between 0.05 and 0.95.
    Without positives or without rows, every document's score is the prior (0.5 without labels).
    """
    known = labels.where(learns & F.col(f"`{label_col}`").isNotNull())
    shares = known.agg(F.avg(F.col(f"`{label_col}`").cast("double")).alias("prior")).first()["prior"]
    prior = min(0.95, max(0.05, 0.5 if shares is None else shares))
    trusted = labelled(labels, id_col, label_col, learns, positives).where("label = 1")
    ids = docs.where(learns).select(F.col(f"`{id_col}`").cast("bigint").alias(f"{OWN}id")).distinct()
    web = ids.orderBy(F.xxhash64(F.lit(3), f"{OWN}id"), f"{OWN}id").limit(unlabelled)
    good, rest = _rows(texts_of(docs, trusted, id_col, text_col)), _rows(texts_of(docs, web, id_col, text_col))
    if len(good) < 2 or len(rest) < 2:
        return Model(np.array([[prior]]), ())
    return fit(good, rest, prior)


def learns(id_col: str = "doc_id") -> Column:
    """The labels that may be learned from; the others are held out."""
    return remainder(id_col, 5) != 0


def scores(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as a last column; null texts count as empty ones. A column of that name is replaced."""

    @F.pandas_udf("double")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.score(np.array([features(t or "") for t in texts]))) if len(texts) else pd.Series(dtype="float64")

    return docs.withColumn(to, run(F.col(f"`{text_col}`").cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; predicted is 1 from a score of 0.3.

    Empty and null texts are scored like others. Repeated rows get equal scores. An empty table gives no rows.
    Language, source and id are no inputs of a score.
    """
    model = train(docs, labels, learns(id_col), id_col, text_col)
    rows = scores(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model)
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
