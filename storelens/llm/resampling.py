"""Target-distribution importance resampling on hashed word runs.

A document's importance is the likelihood ratio of its features under a target corpus and under the documents
themselves, both estimated as histograms over hashed buckets. An untrained Split pre-tokeniser cuts the text, lower-cased
in ASCII only, into words with offsets; a feature is the stretch between the offsets of the first and the last word
of a window, its gaps narrowed to one space, and its bucket the CRC-32 of that stretch. Documents are then drawn
without replacement by Gumbel noise from a hash of their id, so reruns agree.

Texts are read and cut once: what is kept of each is its bucket numbers, two bytes a feature. Histograms are summed inside each
task first, so a frequent word is one row a task. The gains (a number for each bucket) are all that reaches the driver
and goes back to the tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from storelens.functions.ranking import global_rank
from storelens.llm.common import Learned, map_batches
from storelens.session import materialize

#: A word once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024


class Cutter:
    """Turns texts into bucket numbers; one for each task, so it remembers the buckets of words."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        self.lengths = range(shortest, longest + 1)
        self.buckets = buckets
        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.known = Learned(self._bucket)

    def _bucket(self, feature: str) -> int:
        return zlib.crc32(feature.encode()) % self.buckets

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every run of consecutive words."""
        pieces = self.split.pre_tokenize_str((text or "").encode().lower().decode())
        found = []
        for length in self.lengths:
            if length == 1:
                found.append([self.known[word] for word, _ in pieces])
            elif length <= len(pieces):
                found.append(list(map(self._bucket, windows(pieces, length))))
        return len(pieces), np.array([b for part in found for b in part], np.int64)


def windows(pieces: list[tuple[str, tuple[int, int]]], length: int) -> Iterator[str]:
    """Every run of `length` words, cut by offset pairs from the words joined by one space."""
    line = " ".join(word for word, _ in pieces)
    spans = np.array([span for _, span in pieces], np.int64)
    sizes = spans[:, 1] - spans[:, 0]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    for a, b in zip(starts[: len(starts) - length + 1].tolist(), ends[length - 1:].tolist()):
        yield line[a:b]


def cut(
    docs: DataFrame, text_col: str, shortest: int, longest: int, buckets: int, keep: list[str]
) -> DataFrame:
    """_row (a struct of the kept columns), _words (their number) and _cut (the buckets, packed) of every row."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row") if keep else F.lit(None).alias("_row"),
        F.col(f"`{text_col}`").cast("string").alias("_text"))
    state: dict[str, Cutter] = {}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not state:
            state["cutter"] = Cutter(shortest, longest, buckets)
        words, packed = [], []
        for text in batch.column(1).to_pylist():
            n, found = state["cutter"](text)
            words.append(n)
            packed.append(found.astype(width).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.int64()), pa.array(packed, pa.binary())],
            ["_row", "_words", "_cut"])

    kind = rows.schema["_row"].dataType.simpleString()
    return map_batches(rows, run, f"_row {kind}, _words long, _cut binary")


def histogram(cut_rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket, summed in each task and then over tasks."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                found = np.frombuffer(packed, width)
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = cut_rows.select("_cut").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of each bucket's smoothed target share over its share here, rounded down."""
    all_raw, all_target, buckets = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([
        math.floor(1000 * math.log(
            ((t + 1.0) * (all_raw + buckets)) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(raw.tolist(), target.tolist())
    ], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """A thousand times a standard Gumbel variate from the hash of seed and id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def weighted(
    docs: DataFrame,
    target: DataFrame,
    shortest: int = 1,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """_row (the kept columns, by default the id), n_words, n_features, weight and score of every row of docs.

    weight is the mean gain of a row's features, rounded down, 0 without any; score adds Gumbel noise. Null and empty
    texts have no features; texts are taken whole. Rows of one id draw the same noise; a null id draws as empty
    text. An empty target gives gains from smoothing alone. Empty table: no rows.
    """
    keep = list(dict.fromkeys([id_col, *(keep or [])]))
    cut_docs = materialize(cut(docs, text_col, shortest, longest, buckets, keep), "resample-cut")
    cut_target = cut(target, target_text_col, shortest, longest, buckets, [])
    gain = gains(histogram(cut_docs, buckets), histogram(cut_target, buckets))
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        features, weights = [], []
        for packed in batch.column(2).to_pylist():
            found = np.frombuffer(packed, width)
            features.append(len(found))
            weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(features, pa.int64()), pa.array(weights, pa.int64())],
            ["_row", "n_words", "n_features", "weight"])

    kind = cut_docs.schema["_row"].dataType.simpleString()
    scored = map_batches(cut_docs, run, f"_row {kind}, n_words long, n_features long, weight long")
    return (
        scored.withColumn("_id", F.col("_row").getField(id_col))
        .withColumn("score", F.col("weight") + noise("_id", seed)).drop("_id")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    **how,
) -> DataFrame:
    """_row, n_words, n_features, weight, score and rank of every row; rank is null unless drawn.

    Of the rows of at least `least_words` words, `percent` in a hundred (rounded down) are drawn: those of the highest
    scores, ties to the smaller id, null ids last, rows equal in both in any order. Further parameters are those
    of `weighted`.
    """
    scored = materialize(
        weighted(docs, target, keep=keep, id_col=id_col, **how)
        # repeated rows need an order of their own, or all of them would be sorted in one task
        .withColumn("_at", F.monotonically_increasing_id()), "resample-scored")
    able = F.col("n_words") >= least_words
    drawn = (scored.where(able).count() * percent) // 100
    at = F.col("_row").getField(id_col)
    ranked = global_rank(
        scored.where(able), [F.col("score").desc(), at.asc_nulls_last(), "_at"], "rank", "resample-rank")
    return (
        ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        .unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
        .drop("_at")
    )


def drawn_rows(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs with all their columns, texts included; parameters as in `resample`."""
    return resample(docs, target, keep=docs.columns, **how).where("rank IS NOT NULL").select("_row.*")


#: The same in DuckDB with the registered parameters. It has no CRC-32, so that is folded over the bytes of each distinct word.
RESAMPLE_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
b AS (
    SELECT unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM benchmark),
wd AS (SELECT doc_id, unnest(ws) AS w FROM d),
counted AS (SELECT doc_id, w, count(*) AS n FROM wd GROUP BY ALL),
words AS (
    SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM counted UNION SELECT w FROM b)),
hashed AS (
    SELECT w, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT,
            list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) % 10000 AS bucket
    FROM words, crc),
s AS (SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln(
        ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM s FULL JOIN t USING (bucket)),
summed AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight
    FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM d LEFT JOIN summed USING (doc_id)),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score,
       CASE WHEN r <= (10 * n) // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
