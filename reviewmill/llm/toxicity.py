"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes ratios.

A text is the set of its hashed n-grams of 3, 4 and 5 characters (lower case, white space as one
kind of blank). The log-count ratio of an n-gram compares how often toxic and other training texts
hold it. A logistic regression is then fitted on the present n-grams, each with its ratio as its
value. A text's score is the probability of label 1.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

BITS = 18
ORDERS = (3, 4, 5)
#: The classifier is fitted on at most so many labelled texts, chosen by a hash of their id.
TRAIN_ROWS = 8_000
#: An n-gram takes part if so many training texts hold it and its ratio is this far from 0.
LEAST_TEXTS, LEAST_RATIO = 3, 0.7
#: Prior texts per n-gram, shared out by class size; ridge penalty (over the number of texts);
#: steps and rate of the optimizer.
SMOOTHING, RIDGE, STEPS, RATE = 5.0, 1.0, 200, 0.05
#: Bytes of text whose n-grams are in memory at once.
PART = 1 << 18
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def grams(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the different n-grams of each text; ``keep`` marks wanted features."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    text = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    found = []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] + codes[n - 1 :] * np.uint64(_FACTORS[n - 1])
        if n in ORDERS:
            feature = ((h ^ h >> np.uint64(29)) * np.uint64(_FACTORS[0]) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = text[: len(h)] == text[n - 1 :]
            if keep is not None:
                inside &= keep[feature]
            found.append(text[: len(h)][inside] << BITS | feature[inside])
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return every >> BITS, every & ((1 << BITS) - 1)


class Model:
    """Weights per feature and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.keep = weights, bias, weights != 0

    def score(self, texts: list[str]) -> np.ndarray:
        text, feature = grams(texts, self.keep)
        z = np.bincount(text, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, bias=self.bias)
        return out.getvalue()

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            held = np.load(io.BytesIO(f.read()))
        return cls(held["weights"], float(held["bias"]))


def _sample(df: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, rows: int):
    """Labelled training texts, at most ``rows``: (label, text)."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train)
    chosen = (
        usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
        .join(df.select(id_col).distinct(), id_col, "left_semi")
        .orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    # at most `rows` ids: small enough to be sent to every task
    texts = df.select(id_col, text_col).join(F.broadcast(chosen), id_col).dropDuplicates([id_col])
    return c.stored(texts.select("label", F.col(text_col).alias("text")), "toxicity-sample")


def fit(
    df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on labelled texts for which ``train``, a condition on the label's id, holds.

    At most ``rows`` labels are used, chosen by a hash of the id. Rows without id or label do not
    count; an id with both labels is toxic. Without both classes the score is the same everywhere.
    """
    sample = _sample(df, labels, train, id_col, text_col, label_col, rows)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            texts += np.bincount(label, minlength=2)
            at = 0
            for column in c.text_parts(batch.column(1), PART):
                part = [t.as_py() or "" for t in column]
                text, feature = grams(part)
                of = label[at : at + len(part)][text]
                for k in (0, 1):
                    counts[k] += np.bincount(feature[of == k], minlength=1 << BITS).astype(np.int32)
                at += len(part)
        yield pa.RecordBatch.from_arrays(
            [c.binaries([counts.tobytes()]), pa.array(texts[:1]), pa.array(texts[1:])], names=["counts", "no", "yes"])

    parts = sample.coalesce(8).mapInArrow(tally, "counts binary, no bigint, yes bigint").collect()
    counts = sum((np.frombuffer(p["counts"], np.int32).reshape(2, -1).astype(float) for p in parts), np.zeros((2, 1 << BITS)))
    no, yes = sum(p["no"] for p in parts), sum(p["yes"] for p in parts)
    if not (no and yes and counts.sum(axis=1).all()):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((yes + 0.5) / (no + 0.5))))
    size = counts.sum(axis=1)
    prior = SMOOTHING * size / size.sum()  # an n-gram that no text holds has a ratio of 0
    ratio = np.log((counts[1] + prior[1]) / size[1]) - np.log((counts[0] + prior[0]) / size[0])
    keep = (counts.sum(axis=0) >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    name = c.ship(df.sparkSession, "grams", np.packbits(keep).tobytes())

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(c.shipped(name), "rb") as f:
            wanted = np.unpackbits(np.frombuffer(f.read(), np.uint8)).astype(bool)
        for batch in batches:
            sets = []
            for column in c.text_parts(batch.column(1), PART):
                part = [t.as_py() or "" for t in column]
                text, feature = grams(part, wanted)
                bounds = np.searchsorted(text, np.arange(len(part) + 1))
                sets += [feature[s:e].astype(np.int32).tobytes() for s, e in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), c.binaries(sets)], names=["label", "features"])

    rows_ = sample.mapInArrow(present, "label int, features binary").toArrow()
    sets = [np.frombuffer(x.as_buffer(), np.int32) for x in rows_["features"]]
    return _regress(rows_["label"].to_numpy(), sets, ratio, keep)


def _regress(label: np.ndarray, sets: list[np.ndarray], ratio: np.ndarray, keep: np.ndarray) -> Model:
    """Logistic regression on the ratios of the present features, by Adam over all rows."""
    used = np.flatnonzero(keep)
    place = np.zeros(len(ratio), np.int64)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = place[np.concatenate(sets)]
    value = ratio[used][column]
    w, bias = np.zeros(len(used)), float(np.log(label.mean() / (1 - label.mean())))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[column] * value, minlength=len(sets)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - label) / len(sets)
        slope = np.append(np.bincount(column, weights=off[row] * value, minlength=len(used)) + RIDGE / len(sets) * w, off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(bias))


_MODELS: dict[str, Model] = {}


def add_score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability that a text is toxic, between 0 and 1.

    A null or empty text is scored by the bias. Other columns are not looked at and stay; a column
    named ``score_col`` is replaced.
    """
    name = c.ship(df.sparkSession, "toxicity", model.dump())

    def run(column: pa.Array) -> list[pa.Array]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model.read(c.shipped(name))
        return [pa.array(_MODELS[name].score([t.as_py() or "" for t in column]), pa.float64())]

    return c.add_columns(df, text_col, f"{score_col} double", run, PART)
