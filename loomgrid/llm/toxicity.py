"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, both by zstandard's trainer: one on windows of ordinary documents,
one on the spans of toxic documents that make them toxic. A text is read in windows of six words, each half over
the next. A window is compressed with the ordinary dictionary, and with the toxic dictionary after the ordinary one;
the bytes that the toxic dictionary saves are the window's distance. (With the toxic dictionary alone, the
difference tells mostly which ordinary words either dictionary happens to hold.) The windows that save at least
so many bytes are counted at three thresholds, and a document's score is a logistic function of their numbers
and shares. Dictionary sizes, thresholds and weights are calibrated on labelled documents that trained no dictionary.

Which spans of a toxic document are toxic isn't marked. Toxic spans are its words that begin as words of toxic
documents do much more often than words of ordinary ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import OWN, bound_batches, kept, lean
from loomgrid.llm.samples import labelled, remainder, texts_of

#: Labelled documents of each label that are learned from, and the share that calibrates.
LEARNED = 4000
CALIBRATED = 0.3
#: Windows of ordinary documents, and spans of toxic ones, that train the dictionaries: those with the least hashes, from anywhere in the texts.
TAUGHT = 100_000
#: Beginnings of words that mark toxic spans.
MARKS = 4_000
#: Standard deviations by which a mark must be more frequent in toxic documents.
SURE = 3.0
#: Sizes of the ordinary dictionary and of the toxic one that are tried; the trainer's segment and match sizes; the level.
ORDINARY = 65_536
TOXIC = (1024, 2048, 3072, 4096, 8192)
_ORDINARY_COVER = {"k": 32, "d": 6}
_TOXIC_COVER = {"k": 16, "d": 6}
LEVEL = 3
#: Words of a window, of a step to the next, and of a window that trains the ordinary dictionary.
WINDOW, STEP, TAUGHT_WINDOW = 6, 3, 8
#: Bytes to which a toxic span is repeated before it trains.
SPAN = 48
#: Bytes saved among which the thresholds are chosen, and how many are.
VOTES = (1, 2, 3, 4, 5, 6, 7, 8)
CHOSEN = 3
CUT = 0.3
_PAD = b"\n" * 16
#: Fixed value: the three start offsets that end the header of a trained dictionary.
_HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]

    def score(self, votes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(votes, windows, self.thresholds) @ np.array(self.weights), -30, 30)))


def _features(votes: np.ndarray, windows: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """A constant, and shares and numbers of the windows that save at least each threshold; ``votes`` has a column for each of VOTES."""
    counts = votes[:, [VOTES.index(t) for t in thresholds]]
    return np.column_stack((np.ones(len(votes)), np.log1p(1000 * counts / np.maximum(windows, 1)[:, None]) / 5, np.log1p(counts) / 3))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows(words: list[bytes], size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Windows of ``size`` words, a new one every ``step`` words, so that each word is in one at least; fewer words are one window."""
    return [b" " + b" ".join(words[at : at + size]) + b" " for at in range(0, max(1, len(words) - size + step), step)] if words else []


class Voter:
    """Counts the windows of a text by the bytes that the toxic dictionary saves."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compress = [self._with(ordinary), self._with(ordinary + toxic)]

    @staticmethod
    def _with(content: bytes):  # noqa: ANN205
        import zstandard

        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def votes(self, text: str | None) -> tuple[list[int], int]:
        """(how many windows save at least each of VOTES bytes, how many windows)."""
        ordinary, toxic = self.compress
        found = [0] * (VOTES[-1] + 1)
        own, most = windows(words_of(text)), VOTES[-1]
        for window in own:
            window = _PAD + window + _PAD
            saved = len(ordinary(window)) - len(toxic(window))
            if saved > 0:
                found[min(saved, most)] += 1
        return [sum(found[v:]) for v in VOTES], len(own)


def voter(ordinary: bytes, toxic: bytes) -> Voter:
    own = kept("toxicity")
    if (ordinary, toxic) not in own:
        if len(own) > len(TOXIC):
            own.clear()
        own[ordinary, toxic] = Voter(ordinary, toxic)
    return own[ordinary, toxic]


def pairs(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Each word and the one after it."""
    return zip(words, [*words[1:], b""])


def beginnings(word: bytes) -> list[bytes]:
    """The beginnings of a word by which toxic spans are found: of 5 to 12 bytes, with the space before it."""
    word = b" " + word
    return [word[:size] for size in range(5, min(len(word), 12) + 1)]


def span(word: bytes, marks: set[bytes]) -> bytes | None:
    """The longest beginning of a word that is a mark."""
    return next((b for b in reversed(beginnings(word)) if b in marks), None)


def dictionary(samples: list[bytes], size: int, cover: dict[str, int]) -> bytes:
    """The content of the dictionary that zstandard's trainer makes of the samples, without its header and tables."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8], **cover).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: it's its own dictionary
        return b"".join(sorted(set(samples)))[:size]
    return trained[trained.find(_HEADER_END) + len(_HEADER_END) :]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, the first one (of the constant) without penalty."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(parts: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` of the rows of ``parts`` (part), by their hashes; dealt out, since the trainer takes something from each stretch of its samples."""
    found = [bytes(r["part"]) for r in parts.orderBy(F.xxhash64(F.lit(13), "part", "after"), "part", "after").limit(most).collect()]
    return [found[k] for k in np.random.default_rng(17).permutation(len(found))]


def train(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learned: int = LEARNED) -> Model:
    """A model from at most ``learned`` labelled documents of each label among the rows of ``labels`` that meet ``learns``.

    Without labels of both kinds, the model gives every document the share of toxic labels (0.5 if there are none).
    """
    bound_batches(docs.sparkSession)
    sample = labelled(labels, id_col, label_col, learns, learned).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(11), f"{OWN}id"), F.lit(100)) < int(100 * CALIBRATED))
    sample = texts_of(docs, sample, id_col, text_col).persist()
    try:
        n = {(r["label"], r["calibrates"]): r["n"] for r in sample.groupBy("label", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, ordinary = n.get((1, False), 0), n.get((0, False), 0)
        if not (toxic and ordinary and n.get((1, True)) and n.get((0, True))):
            share = (sum(v for k, v in n.items() if k[0] == 1) + 1) / (sum(n.values()) + 2)
            return Model(b"", b"", VOTES[:CHOSEN], (math.log(share / (1 - share)), *[0.0] * (2 * CHOSEN)))

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                    found = {(b, crc32(after)) for word, after in set(pairs(words_of(text))) for b in beginnings(word)}
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([label] * len(found), pa.int32())], ["mark", "after", "label"])

        # how many words follow a mark, not how many documents have it: copies of a document add nothing
        learning = sample.where(~F.col("calibrates"))
        counted = learning.select("text", "label").mapInArrow(lean(begun, "toxicity"), "mark binary, after bigint, label int").distinct().groupBy("mark").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
        # beyond the standard deviations and three times the ordinary rate
        gain = F.col("a") - SURE * F.sqrt("a") - F.lit(3 * toxic / ordinary) * (F.col("b") + 0.5)
        marks = {bytes(r["mark"]) for r in counted.where(gain > 0).orderBy(F.desc(gain), "mark").limit(MARKS).collect()}

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                    words = words_of(text)
                    found = {(mark, crc32(w + b" " + after)) for w, after in pairs(words) if (mark := span(w, marks))} if label else {(w, 0) for w in windows(words, TAUGHT_WINDOW, TAUGHT_WINDOW)}
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([label] * len(found), pa.int32())], ["part", "after", "label"])

        parts = learning.select("text", "label").mapInArrow(lean(cut, "toxicity"), "part binary, after bigint, label int").distinct()
        ordinary_content = dictionary(_sampled(parts.where("label = 0"), TAUGHT), ORDINARY, _ORDINARY_COVER)
        spans = _sampled(parts.where("label = 1"), TAUGHT)
        spans = [s * (1 + SPAN // len(s)) for s in spans]  # what lies across two spans teaches nothing
        tried = [dictionary(spans, size, _TOXIC_COVER) for size in TOXIC]

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voters = [Voter(ordinary_content, content) for content in tried]
            for batch in batches:
                rows = [(label, *(v for own in voters for v in own.votes(text)[0]), len(windows(words_of(text)))) for text, label in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], ["row"])

        rows = np.array([r["row"] for r in sample.where("calibrates").select("text", "label").mapInArrow(lean(vote, "toxicity"), "row array<double>").collect()])
    finally:
        sample.unpersist()
    y, n_windows, best = rows[:, 0], rows[:, -1], None
    for k, content in enumerate(tried):
        votes = rows[:, 1 + k * len(VOTES) : 1 + (k + 1) * len(VOTES)]
        for thresholds in combinations(VOTES, CHOSEN):
            x = _features(votes, n_windows, thresholds)
            w = fit_logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
            if best is None or loss < best[0]:
                best = (loss, Model(ordinary_content, content, thresholds, tuple(w)))
    return best[1]


def scores(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as a last column; null texts count as empty ones. A column of that name is replaced."""

    @F.pandas_udf("double")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        own = voter(model.ordinary, model.toxic)
        found = [own.votes(t or "") for t in texts]
        return pd.Series(model.score(np.array([v for v, _ in found], float).reshape(len(found), len(VOTES)), np.array([n for _, n in found], float)))

    bound_batches(docs.sparkSession)
    return docs.withColumn(to, run(F.col(f"`{text_col}`").cast("string")))


def learns(id_col: str = "doc_id") -> Column:
    """The labels that may be learned from; the others are held out."""
    return remainder(id_col, 4) != 2


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Empty and null texts have no windows and get the score of that. Repeated rows get equal scores. An empty
    table gives no rows. Language, source and id are no inputs of a score.
    """
    model = train(docs, labels, learns(id_col), id_col, text_col)
    rows = scores(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model)
    return rows.select(F.col("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all columns."""
    own = f"{OWN}score"
    return scores(docs, train(docs, labels, learns(id_col), id_col, text_col), text_col, own).where(F.col(own) < cut).drop(own)
