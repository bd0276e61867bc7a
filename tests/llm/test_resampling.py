"""Importance resampling against brute force, with odd input and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from storelens.llm import resampling
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, shortest, longest):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [
        " ".join(words[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, shortest, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    cut = [(i, *features(t, shortest, longest)) for i, t in rows]
    here = Counter(bucket(f) for _, _, fs in cut for f in fs)
    there = Counter(bucket(f) for t in target for f in features(t, shortest, longest)[1])
    n, m = sum(here.values()), sum(there.values())
    out = []
    for i, words, fs in cut:
        gain = [math.floor(1000 * math.log(
            ((there[bucket(f)] + 1) * (n + buckets)) / ((here[bucket(f)] + 1) * (m + buckets)))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(words), len(fs), weight, score])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter(tuple(r) for r in able[: len(able) * percent // 100])
    return out, drawn


@pytest.mark.parametrize("lengths", [(1, 1), (1, 3), (2, 2)])
def test_resampling_is_brute_force(make_docs, odd_rows, spark, lengths):
    rng = random.Random(6)
    rows = odd_rows + [(i, " ".join(prose(i, rng.randrange(1, 60), 30)) + "\x00 A-B É") for i in range(100, 260)]
    rows += [(50, "same text " * 15)] * 40  # one group of copies
    target = [" ".join(prose(900, 80, 12)), None, "", "Other WORDS, other9 É"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, _row int")
    found = [tuple(r) for r in resampling.resample(
        make_docs(rows), bench, percent=30, least_words=5, shortest=lengths[0], longest=lengths[1], buckets=500,
    ).select("_row.doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    expected, drawn = brute([r[:2] for r in rows], target, *lengths, 500, 30, 5)
    assert Counter(r[:5] for r in found) == Counter(map(tuple, expected))
    assert Counter(r[:5] for r in found if r[5] is not None) == drawn
    ranked = sorted((r for r in found if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in ranked] == list(range(1, len(ranked) + 1))
    assert [(-r[4], r[0] is None, r[0] or 0) for r in ranked] == sorted(
        (-r[4], r[0] is None, r[0] or 0) for r in ranked)


def test_windows_come_from_offsets():
    pieces = resampling.Cutter(1, 1, 10).split.pre_tokenize_str("ab--cd  é\U0001F600 x")
    assert list(resampling.windows(pieces, 2)) == ["ab cd", "cd é\U0001F600", "é\U0001F600 x"]


def test_empty_tables_and_whole_rows(make_docs, spark):
    docs = make_docs([(i, " ".join(prose(i, 30))) for i in range(50)])
    none = docs.where("doc_id < 0")
    assert resampling.resample(none, docs).collect() == []
    assert {r["rank"] for r in resampling.resample(docs, none).collect()} == {None, 1, 2, 3, 4, 5}
    drawn = resampling.drawn_rows(docs, docs.limit(5))
    assert drawn.columns == docs.columns
    assert drawn.count() == 5
    wide = resampling.resample(docs, none, buckets=100_000).where("rank = 1").collect()
    assert len(wide) == 1
