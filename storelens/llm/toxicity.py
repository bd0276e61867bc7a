"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other labelled documents, both smoothed by a Dirichlet
prior: the token's share of all documents times PRIOR tokens. A word counts once a document, so a
document that repeats itself teaches no more than another. Rare word forms back off to their prefixes; a positive
score whose likelihood ratio statistic is below LEAST_RATIO (about one in ten million by chance) counts
as 0. DRIFT is taken off every score, so
unremarkable text has a negative sum and a passage stands out as a segment whose sum is large. Every
occurrence of a word scores as it stands; within one segment a word adds to the sum at most OCCURRENCES
times.

All maximal segments of a document are found in one pass over its tokens (Ruzzo and Tompa). The
best segment of a clean document follows an extreme-value law: of n tokens it exceeds s with a
probability near 1 - exp(-K n exp(-lambda s)) (Karlin and Altschul); lambda follows from the scores of clean
tokens, K from the best segments of the clean sample. A segment is significant if fewer than ALPHA such are
expected in a clean document of that length. A document's evidence is the sum of lambda s - ln(K n)
over its significant segments, and its score a logistic curve of that, fitted on the sample.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import Learned, chunks, map_batches
from storelens.llm.samples import labelled_sample
from storelens.session import materialize

PER_CLASS = 10_000  # labelled documents of each label to learn from, at most
PREFIXES = (6, 5, 4)
LEAST_SEEN = 8  # sample documents below which a word backs off to its prefixes
DISTINCT = 200_000  # words that a task holds before it adds them up by feature; only memory depends on it
PRIOR, DRIFT, ALPHA, LEAST_RATIO, OCCURRENCES = 2_000.0, 0.25, 0.05, 28.0, 2
SHARE = 0.15  # of toxic documents that the scores assume
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»„“”’‘…–—"


@dataclass
class Model:
    scores: dict[str, float]
    unknown: float
    lam: float
    log_k: float
    slope: float
    offset: float


def features(word: str) -> list[str]:
    """The word without case and outer punctuation, then its prefixes, the most specific first."""
    plain = word.lower().strip(_EDGE)
    return [plain, *(f"{plain[:n]}-" for n in PREFIXES if len(plain) > n)] if plain else []


class Forms:
    """A value for each feature, looked up by the word: its plain form first, then its prefixes."""

    def __init__(self, values: dict):
        self.whole = {f: v for f, v in values.items() if not f.endswith("-")}
        self.starts = [
            (n, {f[:n]: v for f, v in values.items() if f.endswith("-") and len(f) == n + 1}) for n in PREFIXES]

    def all(self, word: str) -> list:
        """The values of all features of the word that have one."""
        plain = word.lower().strip(_EDGE)
        out = [self.whole[plain]] if plain in self.whole else []
        return out + [start[plain[:n]] for n, start in self.starts if len(plain) > n and plain[:n] in start]

    def first(self, word: str, other: float) -> float:
        """The value of the most specific feature of the word that has one."""
        plain = word.lower().strip(_EDGE)
        value = self.whole.get(plain)
        if value is not None:
            return value
        for n, start in self.starts:
            if len(plain) > n:
                value = start.get(plain[:n])
                if value is not None:
                    return value
        return other


def coded(texts: list[str | None]) -> Iterator[tuple[list[list[str]], np.ndarray, np.ndarray, list[str]]]:
    """Pieces of the texts, a few MB each, as the words of each text, the ends of the texts among all words, the number
    of each word and the distinct words by number. So what is done for a word is done once for each piece."""
    for a, b in chunks([len(t or "") for t in texts]):
        words = [(t or "").split() for t in texts[a:b]]
        ends = np.cumsum([len(w) for w in words])
        column = pa.array(chain.from_iterable(words), pa.large_string()).dictionary_encode()
        yield words, ends, column.indices.to_numpy(), column.dictionary.to_numpy(zero_copy_only=False).tolist()


def counted(sample: DataFrame) -> DataFrame:
    """feature, toxic, other: occurrences in the labelled sample, a word counted once a document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        known = Learned(features)
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word in set((text or "").split()):
                seen[label].update(known[word])
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()),
             pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "toxic", "other"])

    return map_batches(
        sample.select("text", "label"), run, "feature string, toxic long, other long"
    ).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def background(docs: DataFrame, vocabulary: list[str], text_col: str) -> tuple[dict[str, int], int]:
    """How often each feature occurs in all documents, a word counted once a document, and the
    number of words so counted."""

    def run(batches):
        total, seen, words = 0, Counter(), Counter()
        forms = Forms({f: f for f in vocabulary})

        def add_up():
            for word, n in words.items():
                for feature in forms.all(word):
                    seen[feature] += n
            words.clear()

        for batch in batches:
            for _, ends, code, distinct in coded(batch.column(0).to_pylist()):
                if not distinct:
                    continue
                text = np.searchsorted(ends, np.arange(len(code)), side="right")
                once = np.unique(text * len(distinct) + code) % len(distinct)
                total += len(once)
                for word, n in zip(distinct, np.bincount(once, minlength=len(distinct)).tolist()):
                    words[word] += n
                if len(words) > DISTINCT:
                    add_up()
        add_up()
        names = ["", *seen]  # the empty name holds the tokens
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([total, *seen.values()], pa.int64())], ["feature", "n"])

    rows = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, "feature string, n long")
        .groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most a row for each of the vocabulary
    )
    found = {r["feature"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def log_odds(y: tuple[int, int], n: tuple[int, int], share: float) -> float:
    """Of a token seen y times in n tokens, toxic and other, with PRIOR * share more in either."""
    a = [(y[i] + PRIOR * share + 0.1) / (n[i] + PRIOR + 0.1) for i in (0, 1)]
    odds = math.log(a[0] / (1 - a[0])) - math.log(a[1] / (1 - a[1]))
    expected = [sum(y) * n[i] / sum(n) for i in (0, 1)]
    ratio = 2 * sum(y[i] * math.log(y[i] / expected[i]) for i in (0, 1) if y[i])
    return odds if odds < 0 or ratio >= LEAST_RATIO else 0.0


class Scorer:
    """The words of texts with their scores."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.forms, self.unknown = Forms(scores), unknown

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
        for words, ends, code, distinct in coded(texts):
            values = np.fromiter((self.forms.first(w, self.unknown) for w in distinct), float, len(distinct))
            yield from zip(words, np.split(values[code], ends[:-1]))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) in one pass.

    Runs of tokens that only lower the sum are skipped over by prefix sums, so the loop runs over the
    positive tokens. Each new token becomes a segment; while an earlier one begins lower and ends
    lower, they and all between become one. Each segment knows the last one that begins lower, so no segment
    is looked at twice before it is joined, and once none begins lower all before are final: the scan is linear.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    out: list[tuple[int, int, float]] = []
    found: list[list] = []  # first, end, sum before, sum after, the last earlier one that begins lower (or -1)
    for i, before, after in zip(
        at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist()
    ):
        new = [i, i + 1, before, after]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]  # those between begin no lower than the one they are skipped from
            if j < 0:
                # none begins lower, so nothing before can ever be joined with what comes
                out += [(a, b, high - low) for a, b, low, high, _ in found]
                found = [[*new, -1]]
                break
            if found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            skip = found[j][4]
            del found[j:]
            j = skip
    return out + [(a, b, high - low) for a, b, low, high, _ in found]


def limited(words: list[str], scores: np.ndarray) -> float:
    """The largest sum of a stretch in which a word adds its positive score at most OCCURRENCES times.

    The stretches that end at a token are kept by their starts, as the sum from the first start and
    the differences between neighbours. What a token adds, it adds to all starts since its word's last
    counted one, so a start that falls to the sum of a later one stays below it and is dropped.
    """
    best, lowered = 0.0, 0.0  # sums are kept without the tokens that lower them, `lowered` so far
    starts: list[int] = []
    above: list[float] = []  # by how much the sum from each start is above the next one's
    top = 0.0  # the sum from starts[0]
    last = 0.0  # and from the last start
    met: dict[str, list[int]] = {}
    for i, s in enumerate(scores.tolist()):
        if s <= 0:
            lowered += s
            continue
        places = met.setdefault(words[i], [])
        since = places[-OCCURRENCES] + 1 if len(places) >= OCCURRENCES else 0
        places.append(i)
        if starts:
            above.append(last + lowered)
        else:
            top = -lowered
        starts.append(i)
        last = s - lowered
        k = bisect_left(starts, since) - 1  # the last start that the token adds nothing to
        if k < 0:
            top += s
        else:
            above[k] -= s
        drop = [len(starts) - 2, k]
        for at in drop:
            while 0 <= at < len(above) and above[at] <= 0:
                gap = above.pop(at)
                starts.pop(at)
                if at:
                    above[at - 1] += gap
                else:
                    top -= gap
                at -= 1
        best = max(best, top + lowered)
    return best


def passages(words: list[str], scores: np.ndarray, floor: float = 0.0) -> list[tuple[int, int, float]]:
    """The segments of a text whose sum is above `floor`, every occurrence scored as it stands, with their limited sums.

    A limited sum is no larger than the segment's own, so a segment at or below the floor has no part in what is above it.
    """
    out = []
    for a, b, s in segments(scores):
        if s <= floor:
            continue
        often = Counter(words[i] for i in range(a, b) if scores[i] > 0)
        if max(often.values()) > OCCURRENCES:
            s = limited(words[a:b], scores[a:b])
        out.append((a, b, s))
    return out


def decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1."""
    share = weights / weights.sum()
    low, high = 1e-6, 1.0

    def over(lam: float) -> bool:
        return float((share * np.exp(np.minimum(lam * scores, 700))).sum()) > 1

    while not over(high) and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> tuple[float, int]:
    """Sum over significant segments of lambda s - ln(K n), and their number."""
    total, count, size = 0.0, 0, log_k + math.log(max(n, 1))
    for _, _, s in found:
        bits = lam * s - size  # exp(-bits) such segments are expected
        if bits > -math.log(ALPHA):
            total += bits
            count += 1
    return total, count


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve, label 1 weighing SHARE of all; slightly penalised."""
    weight = np.where(y == 1, SHARE / max(1, (y == 1).sum()), (1 - SHARE) / max(1, (y == 0).sum()))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 1e-4 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learns,
    target: str = "toxic",
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """The model, from at most per_class documents of each label and the word counts of all documents.

    `learns` says of the column `_id` which labels may be used. Words and prefixes in at least LEAST_SEEN documents of the
    sample are scored, however many. Without labelled documents of both kinds no passage is found, and every
    document has the one score of no evidence, below 0.0001.
    """
    renamed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = labelled_sample(
        renamed, labels.select(F.col(id_col).alias("doc_id"), target), target, learns, per_class,
        ["doc_id", "text"])
    found = materialize(counted(sample), "toxicity-words")
    kept = found.where(F.col("toxic") + F.col("other") >= LEAST_SEEN).collect()  # of the bounded sample
    counts = {r["feature"]: (r["toxic"], r["other"]) for r in kept}
    n = tuple(found.where(~F.col("feature").endswith("-")).agg(
        F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first())
    everywhere, tokens = background(docs, list(counts), text_col)
    whole = [f for f in counts if not f.endswith("-")]
    if not n[0] or not n[1] or not tokens:
        return Model({}, -DRIFT, 1.0, 0.0, 0.0, -10.0)
    scores = {
        f: log_odds(y, n, everywhere.get(f, 0) / tokens) - DRIFT
        for f, y in counts.items() if everywhere.get(f)
    }
    unknown = -DRIFT
    rows = _measured(sample, scores, unknown)
    clean = [r for r in rows if r["label"] == 0 and r["n"]]
    values = np.array([scores[f] for f in whole if f in scores])
    weights = np.array([counts[f][1] for f in whole if f in scores], float)
    rest = max(0.0, n[1] - weights.sum())
    lam = decay(np.r_[values, unknown], np.r_[weights, rest])
    best = np.array([max((s for s in r["sums"]), default=0.0) for r in clean])
    sizes = np.array([r["n"] for r in clean])
    # the mean of lambda s - ln n is ln K + Euler's constant; the median is less moved by mislabelled rows
    log_k = float(np.median(lam * best - np.log(sizes)) + math.log(math.log(2)))
    x = np.array([
        evidence([(0, 0, s) for s in r["sums"]], r["n"], lam, log_k)[0] for r in rows])
    slope, offset = logistic(np.log1p(x), np.array([r["label"] for r in rows], float))
    return Model(scores, unknown, lam, log_k, slope, offset)


def _measured(sample: DataFrame, scores: dict[str, float], unknown: float) -> list:
    """label, n (tokens) and sums (of the segments) of each document of the bounded sample."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(scores, unknown)
        sizes, sums = [], []
        for words, scored in scorer(batch.column(0).to_pylist()):
            sizes.append(len(words))
            sums.append([s for _, _, s in passages(words, scored)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
            ["label", "n", "sums"])

    return map_batches(
        sample.select("text", "label"), run, "label int, n long, sums array<double>").collect()


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, score (0 to 1) and passages (first word, end word, sum, expected number by chance).

    A narrow map: one row out for each row in, repeated rows and null ids included. Null and empty texts
    have no passages and the score of no evidence. Passages are all significant segments of the whole
    text, in its order; equal sums are all kept. The sum is that of the best stretch of the segment in which
    no word counts more than OCCURRENCES times. Other columns are ignored.
    """

    def run(batches):
        scorer = Scorer(model.scores, model.unknown)
        kind = pa.list_(pa.struct([
            ("first", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()),
            ("expected", pa.float64())]))
        for batch in batches:
            values, listed = [], []
            for words, scored in scorer(batch.column(1).to_pylist()):
                size = model.log_k + math.log(max(len(words), 1))
                # the least sum that can be significant, less a little for rounding
                floor = (size - math.log(ALPHA)) / model.lam - 1e-6
                found = passages(words, scored, max(0.0, floor))
                total, _ = evidence(found, len(words), model.lam, model.log_k)
                logit = model.slope * math.log1p(total) + model.offset
                values.append(1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))))
                listed.append([
                    {"first": a, "end": b, "sum": s, "expected": math.exp(size - model.lam * s)}
                    for a, b, s in found if size - model.lam * s < math.log(ALPHA)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64()), pa.array(listed, kind)],
                ["id", "score", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(
        run, f"id {kind}, score double,"
        " passages array<struct<first:bigint,end:bigint,sum:double,expected:double>>"
    ).withColumnRenamed("id", id_col)
