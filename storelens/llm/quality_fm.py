"""Quality scores by a factorisation machine.

A document's features are its hashed words, structure statistics of the whole text and its declared
length; statistics are cut into bins, so that a pair of bins can interact. Every feature has a weight and
a vector of RANK numbers, and a pair of features interacts by the product of its vectors. All
pairs are summed in linear time: half of (sum of v x) squared less the sum of (v x) squared.

It is fitted by Adam on a bounded sample of labelled documents, in one task, in an order that ids alone
decide; what leaves that task is the model, some 45 KB whatever the data.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import Learned, map_batches, texts
from storelens.llm.samples import labelled_sample

PER_CLASS = 8_000  # labelled documents of each label to learn from, at most
BUCKETS, BINS, RANK = 1024, 16, 8
STATISTICS = 14  # of structure, with the declared length
WIDTH = BUCKETS + STATISTICS * BINS
EPOCHS, BATCH, STEP, PENALTY = 15, 256, 0.01, 1e-5
SHARE = 0.8  # of documents with label 1 that the scores assume

_UPPER, _LOWER, _DIGIT = (
    np.array([b in chars for b in range(256)])
    for chars in (range(65, 91), range(97, 123), range(48, 58))
)
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_END = np.array([b in b".!?" for b in range(256)])


def _hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower()) % BUCKETS


def statistics(text: bytes, words: list[bytes], buckets: np.ndarray, n_chars: int | None) -> list[float]:
    """Numbers between 0 and 1 that describe the build of a text."""
    n = max(1, len(words))
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    letters = max(1, counts[_UPPER].sum() + counts[_LOWER].sum())
    size = max(1, len(raw))
    lines = text.split(b"\n")
    marks = _MARK[raw]
    doubled = int((marks[1:] & (raw[1:] == raw[:-1])).sum())
    return [
        math.log2(len(words) + 1) / 20,
        min(1.0, size / n / 24),
        len(set(words)) / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        math.sqrt(counts[_UPPER].sum() / letters),
        math.sqrt(counts[_DIGIT].sum() / size),
        math.sqrt(marks.sum() / size),
        math.sqrt(counts[124] / n) if counts[124] < n else 1.0,
        1 - len(set(lines)) / len(lines),
        min(1.0, math.log2(max(map(len, lines)) + 1) / 20),
        math.sqrt(buckets.max() / n) if len(words) else 0.0,
        math.sqrt(doubled / size),
        min(1.0, math.sqrt(counts[_END].sum() / n)),
        -1.0 if n_chars is None else min(1.0, math.log2(max(0, n_chars) + 1) / 24),
    ]


class Features:
    """Feature rows of documents; remembers the words it has met."""

    def __init__(self):
        self.known = Learned(_hash_word)

    def __call__(self, text: bytes, n_chars: int | None) -> np.ndarray:
        words = text.split()
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        buckets = np.bincount(found, minlength=BUCKETS)
        row = np.zeros(WIDTH, np.float32)
        if len(words):
            row[:BUCKETS] = np.log1p(buckets)
            row[:BUCKETS] /= np.sqrt((row[:BUCKETS] ** 2).sum())
        for i, value in enumerate(statistics(text, words, buckets, n_chars)):
            if value >= 0:
                row[BUCKETS + i * BINS + min(BINS - 1, int(value * BINS))] = 0.5
        return row


class Machine:
    """Weights w0, w (WIDTH) and v (WIDTH x RANK)."""

    def __init__(self, flat: np.ndarray):
        self.w0, self.w = flat[0], flat[1: WIDTH + 1]
        self.v = flat[WIDTH + 1:].reshape(WIDTH, RANK)

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s**2).sum(axis=1) - (x**2) @ (self.v**2).sum(axis=1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """The flat weights after EPOCHS passes; label 1 weighs SHARE of all."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(1 + WIDTH + WIDTH * RANK, np.float32)
    flat[1 + WIDTH:] = rng.normal(0, 0.02, WIDTH * RANK)
    mean, square, steps = np.zeros_like(flat), np.zeros_like(flat), 0
    good = max(1, (y == 1).sum())
    bad = max(1, (y == 0).sum())
    share = np.where(y == 1, SHARE / good, (1 - SHARE) / bad) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rows = order[a: a + BATCH]
            xb, machine = x[rows], Machine(flat)
            off = ((machine(xb) - y[rows]) * share[rows]).astype(np.float32) / len(rows)
            s = xb @ machine.v
            grad = np.concatenate([
                [off.sum()], xb.T @ off,
                (xb.T @ (off[:, None] * s) - ((xb**2).T @ off)[:, None] * machine.v).ravel(),
            ]).astype(np.float32) + PENALTY * flat
            steps += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad**2
            flat = flat - STEP * (mean / (1 - 0.9**steps)) / (
                np.sqrt(square / (1 - 0.999**steps)) + 1e-8)
    return flat.astype(np.float32)


def _inputs(docs: DataFrame, text_col: str) -> list:
    """text and n_chars (null where docs has no such column)."""
    declared = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return [F.col(text_col).cast("string").alias("text"), declared.cast("bigint").alias("n_chars")]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learns,
    target: str = "quality",
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> np.ndarray | None:
    """The flat weights, from at most per_class documents of each label; None without both labels.

    `learns` says of the column `_id` which labels may be used.
    """
    renamed = docs.select(F.col(id_col).alias("doc_id"), *_inputs(docs, text_col))
    sample = labelled_sample(
        renamed, labels.select(F.col(id_col).alias("doc_id"), target), target, learns, per_class,
        ["doc_id", "text", "n_chars"])

    def featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        make = Features()
        rows = [make(t, n).astype(np.float16).tobytes()
                for t, n in zip(texts(batch.column(0)), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), batch.column(2), batch.column(3)], ["x", "y", "at"])

    def one(rows):
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16)
        y = rows.column("y").to_numpy()
        order = np.argsort(rows.column("at").to_numpy(), kind="stable")
        x = x.reshape(len(y), WIDTH)[order].astype(np.float32)
        both = len(np.unique(y)) == 2
        flat = train(x, y[order]) if both else np.empty(0, np.float32)
        return pa.table({"model": pa.array([flat.tobytes()], pa.binary())})

    at = F.xxhash64("doc_id", "text").alias("at")
    rows = map_batches(
        sample.select("text", "n_chars", "label", at), featured, "x binary, y int, at long")
    fitted = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(one, "model binary")
    model = fitted.collect()  # one row
    return np.frombuffer(model[0]["model"], np.float32).copy() if model and model[0]["model"] else None


def scored_rows(docs: DataFrame, model: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """_row (a struct of all columns of docs) and score, 0 to 1, higher for quality.

    A narrow map: one row out for each row in, repeated rows and null ids included. A null text is scored
    as an empty one, which has structure but no words; of a null or absent n_chars nothing is known, so its
    feature is left out. Without a model every score is 0.5. Empty table: no rows.
    """

    def run(batches):
        make = Features()
        machine = Machine(model) if model is not None else None
        for batch in batches:
            contents, declared = texts(batch.column(1)), batch.column(2).to_pylist()
            scores = []
            for a in range(0, len(contents), BATCH):
                x = np.stack([make(t, n) for t, n in zip(
                    contents[a:a + BATCH], declared[a:a + BATCH])])
                x = x.astype(np.float16).astype(np.float32)
                scores.append(machine(x) if machine else np.full(len(x), 0.5))
            found = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_row", "score"])

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_inputs(docs, text_col))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, score double")


def score_documents(
    docs: DataFrame, model: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and score of every row of docs, as scored_rows has it; other columns are ignored."""
    narrow = docs.select(*dict.fromkeys(
        [id_col, text_col, *(["n_chars"] if "n_chars" in docs.columns else [])]))
    return scored_rows(narrow, model, text_col).select(F.col("_row").getField(id_col).alias(id_col), "score")
