"""Toxicity, token counts, quality, decontamination and licences against brute force and odd input."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storelens.llm import decontamination as dc
from storelens.llm import licenses, quality_fm, token_counts, toxicity
from storelens.llm.common import Learned, crc_rest
from storelens.llm.license_templates import TEMPLATES
from storelens.llm.queries import TOKENIZER_FILE
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def tables(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{name}.parquet")
    return read("documents"), read("labels")


# Token counts


def test_token_counts_equal_the_library(make_docs, odd_rows, tables):
    library = Tokenizer.from_file(TOKENIZER_FILE)
    rows = odd_rows + [(100 + r["doc_id"], r["text"]) for r in tables[0].limit(150).collect()]
    rows += [(999, "a  b\r\n\r\n  c' 's ''s 12é34 日本語 \x85\xa0 　x don't"), (998, "a" * 5000)]
    found = token_counts.count_tokens(make_docs(rows), TOKENIZER_FILE).collect()
    assert len(found) == len(rows)
    expected = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)))
        for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in found)


def test_token_counts_of_no_rows_and_other_tokenizers(make_docs):
    assert token_counts.count_tokens(make_docs([]), TOKENIZER_FILE).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(make_docs([]), public_tokenizers.path("word_bpe_49k.json"))


def test_learned_forgets_without_changing_values():
    learned = Learned(lambda k: k * 2, {1: 7}, most=3)
    assert [learned[k] for k in (1, 2, 3, 4, 5, 6, 1, 2)] == [7, 4, 6, 8, 10, 12, 7, 4]


# Toxicity


def test_every_passage_of_a_long_document_is_found(make_docs):
    words = [f"bad{k}" for k in range(12)]
    model = toxicity.Model({w: 3.0 for w in words}, -toxicity.DRIFT, 1.0, 0.0, 1.0, -5.0)
    text, expected = ["bad1", *prose(1, 300), "bad1", *prose(2, 300)], []
    for k in range(5):
        expected.append((len(text), len(text) + 12))
        text += words + prose(10 + k, 400)
    rows = [(1, " ".join(text)), (2, " ".join(["bad0"] * 200))]
    found = {r["doc_id"]: r for r in toxicity.score_documents(make_docs(rows), model).collect()}
    assert [(p["first"], p["end"]) for p in found[1]["passages"]] == expected
    assert all(p["sum"] == 36.0 for p in found[1]["passages"])
    assert found[2]["passages"] == []


def test_limited_sums_against_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        value = {f"w{k}": rng.choice([-1.5, -0.25, 0.5, 1.0, 3.0]) for k in range(rng.randrange(1, 6))}
        words = [rng.choice(list(value)) for _ in range(rng.randrange(1, 22))]
        best = 0.0
        for a in range(len(words)):
            total = 0.0
            for b in range(a, len(words)):
                s = value[words[b]]
                total += s if s <= 0 or words[a:b].count(words[b]) < toxicity.OCCURRENCES else 0
                best = max(best, total)
        assert math.isclose(best, toxicity.limited(words, np.array([value[w] for w in words])), abs_tol=1e-9)


def brute_segments(scores):
    """Maximal segments by their definition: every proper part sums to less, and none contains another."""
    n, total = len(scores), np.r_[0, np.cumsum(scores)]
    good = []
    for a in range(n):
        for b in range(a + 1, n + 1):
            inner = [(c, d) for c in range(a, b + 1) for d in range(c + 1, b + 1) if (c, d) != (a, b)]
            s = total[b] - total[a]
            if s > 0 and all(total[d] - total[c] < s - 1e-12 for c, d in inner):
                good.append((a, b))
    return [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(60):
        scores = np.array([rng.choice([-2.1, -1.3, -0.37, 0.41, 1.7, 2.9]) + rng.random() / 97 for _ in range(9)])
        found = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in found] == brute_segments(scores)
        assert all(math.isclose(s, scores[a:b].sum()) for a, b, s in found)
    assert toxicity.segments(np.array([])) == [] and toxicity.segments(np.array([-1.0])) == []


def test_decay_solves_its_equation():
    scores, weights = np.array([2.0, -1.0, -0.5]), np.array([1.0, 6.0, 3.0])
    lam = toxicity.decay(scores, weights)
    assert math.isclose((weights / weights.sum() * np.exp(lam * scores)).sum(), 1, rel_tol=1e-6)


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(1000 + seed * n + i, rng.randrange(30, 90))
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vilewort", "slurgle", "mockery"], k=3)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_and_odd_rows(spark, make_docs, odd_rows):
    rows, labels = toxic_rows(600)
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, crc_rest("_id", 3) != 1)
    scored = toxicity.score_documents(docs, model).withColumn("held", crc_rest("doc_id", 3) == 1)
    held = [r for r in scored.collect() if r["held"]]
    assert len(held) > 100
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held)
    words = dict(rows)
    for r in held:
        for p in r["passages"]:
            inside = words[r["doc_id"]].split()[p["first"]:p["end"]]
            assert {"vilewort", "slurgle", "mockery"} & set(inside)
    odd = toxicity.score_documents(make_docs(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_documents(make_docs([]), model).collect() == []


def test_toxicity_without_labels(spark, make_docs, odd_rows):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(make_docs(odd_rows), empty, F.lit(True))
    assert {r["score"] < 0.01 for r in toxicity.score_documents(make_docs(odd_rows), model).collect()} == {True}


def test_registered_toxicity_is_accurate_on_held_out(spark, sf):
    from storelens.llm.queries import op1_toxicity

    small = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = op1_toxicity(spark, small).join(labels, "doc_id").collect()
    right = [r["predicted"] == r["toxic"] for r in found if r["held_out"]]
    assert sum(right) / len(right) > 0.9


# Quality


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(1)
    flat = rng.normal(0, 0.1, 1 + quality_fm.WIDTH * (1 + quality_fm.RANK)).astype(np.float32)
    x = np.zeros((2, quality_fm.WIDTH), np.float32)
    x[0, [3, 70, 900]], x[1, [5, 6]] = [0.5, 1.0, 2.0], [1.0, -1.0]
    machine = quality_fm.Machine(flat)
    for row, value in zip(x, machine.raw(x)):
        at = np.flatnonzero(row)
        pairs = sum(machine.v[i] @ machine.v[j] * row[i] * row[j] for k, i in enumerate(at) for j in at[k + 1:])
        assert math.isclose(value, machine.w0 + row @ machine.w + pairs, rel_tol=1e-3, abs_tol=1e-4)


def test_registered_quality_is_accurate_on_held_out(spark, sf):
    from storelens.llm.queries import op5_quality

    small = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = op5_quality(spark, small).join(labels, "doc_id").collect()
    right = [r["predicted"] == r["quality"] for r in found if r["held_out"]]
    assert sum(right) / len(right) > 0.93


def test_quality_of_odd_rows(make_docs, odd_rows, tables):
    model = quality_fm.fit(*tables, crc_rest("_id", 4) != 2, per_class=200)
    found = quality_fm.score_documents(make_docs(odd_rows), model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert quality_fm.score_documents(make_docs([]), model).collect() == []
    none = quality_fm.fit(make_docs(odd_rows), tables[1].where("doc_id < 0"), F.lit(True))
    assert {r["score"] for r in quality_fm.score_documents(make_docs(odd_rows), none).collect()} == {0.5}


# Decontamination


def brute_stretch(equal, similarity):
    best = (0, 0)
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            if sum(equal[a:b]) >= similarity * (b - a) - 1e-9 and b - a > best[1] - best[0]:
                best = (a, b)
    return best


def test_longest_stretch_is_the_longest():
    rng = random.Random(5)
    for _ in range(200):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randrange(0, 18))], bool)
        a, b = dc.longest_stretch(equal, 0.8)
        x, y = brute_stretch(equal.tolist(), 0.8)
        assert b - a <= y - x
        if y > x:  # the ends of the longest may be unequal places, which are left out
            assert equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-9
            assert equal[a:b].sum() >= sum(equal[x:y]) - 1e-9


def test_passages_are_found_through_substitutions(spark, make_docs, odd_rows):
    items = [(i, " ".join(prose(50 + i, 30))) for i in range(8)]
    items += [(100, "alpha beta gamma delta epsilon zeta"), (101, None), (102, ""), (None, items[0][1]), (103, "!!! ...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, expected = [], set()
    rng = random.Random(9)
    for i in range(8):
        words = items[i][1].split()
        for k in rng.sample(range(3, 27), 3):
            words[k] = f"changed{k}"
        rows.append((200 + i, " ".join(prose(300 + i, 40) + words + prose(400 + i, 20))))
        expected.add((200 + i, i))
    rows += [(300, f"x y ALPHA, beta gamma delta epsilon zeta! {' '.join(prose(7, 9))}"),
             *((400 + i, " ".join(prose(500 + i, 80))) for i in range(20)), *odd_rows]
    expected.add((300, 100))
    docs = make_docs(rows)
    found = dc.find_overlaps(docs, bench).collect()
    named = {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] is not None}
    assert named == expected
    assert {r["doc_id"] for r in found if r["item_id"] is None} == {200}
    assert all(r["n_equal"] >= 0.8 * r["n_tokens"] for r in found)
    kept = dc.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 9
    assert dc.find_overlaps(make_docs([]), bench).collect() == []
    assert dc.find_overlaps(docs, bench.where("item_id < 0")).collect() == []
    assert dc.without_contaminated(docs, bench.where("item_id < 0")).count() == len(rows)


def qualifying(length, similarity=0.8):
    """All patterns of that length with equal ends and that share of equal places."""
    most = min(max(0, length - 2), math.floor((1 - similarity) * length + 1e-9))
    for gone in (c for k in range(most + 1) for c in itertools.combinations(range(1, length - 1), k)):
        yield np.array([i not in gone for i in range(length)])


def test_every_allowed_pattern_is_found():
    for size in (*range(1, 17), 20, 24):
        item = [f"w{k}" for k in range(size)]
        index = dc.Index([(1, " ".join(item).encode())])
        hashes = index.items[0][0]
        for length in range(min(13, max(1, math.ceil(0.8 * size - 1e-9))), min(size, 20) + 1):
            for at in {0, (size - length) // 2, size - length}:  # words before and after are others
                for number, equal in enumerate(qualifying(length)):
                    if length > 16 and number % 7:
                        continue
                    text = np.arange(1, size + 1, dtype=np.uint64)
                    text[at:at + length][equal] = hashes[at:at + length][equal]
                    found = [(a, b) for _, a, b, _, _ in dc.overlaps(index, text, 13, 0.8)]
                    assert found == [(at, at + length)], (size, at, equal)


def test_no_long_pattern_avoids_the_masks():
    for least in range(1, 14):
        masks = [int(m, 2) for m in dc.masks_for(least, 0.8)]
        span = max(m.bit_length() for m in masks)
        states = 1 << (span - 1)
        hit = np.array([any(w & m == m for m in masks) for w in range(2 * states)])
        low = -10**6
        best = np.full(states, low)  # by the last places: most of equal ones less four times the others
        best[1 % states] = 1
        if hit[1]:
            continue
        for length in range(2, 150):
            now = np.full(states, low)
            came = np.arange(states)
            for bit, gain in ((0, -4), (1, 1)):
                w = came << 1 | bit
                ok = (best > low) & ~hit[w]
                np.maximum.at(now, w[ok] % states, best[ok] + gain)
            best = now
            assert length < least or best[1::2].max() < 0, (least, length)


def test_closed_stretch_is_the_longest_with_equal_ends():
    rng = random.Random(7)
    for _ in range(400):
        equal = np.array([rng.random() < 0.75 for _ in range(rng.randrange(0, 22))], bool)
        a, b = dc.longest_stretch(equal, 0.8, closed=True)
        best = max((y - x, -x) for x in range(len(equal) + 1) for y in range(x, len(equal) + 1)
                   if x == y == 0 or (y > x and equal[x] and equal[y - 1] and equal[x:y].mean() >= 0.8 - 1e-9))
        assert (b - a, -a) == best


def test_leaks_of_the_least_length_and_of_short_items(spark, make_docs):
    items = [(1, " ".join(prose(61, 13))), (2, " ".join(prose(62, 15))), (3, "one two three four five"),
             (4, " ".join(prose(63, 20)))]
    changed = {1: {4, 8}, 2: {3, 7, 11}, 3: {4}, 4: {3, 7, 11, 15}}
    rows = [(i, " ".join(["before", *(f"x{k}" if k in changed[i] else w for k, w in enumerate(t.split())), "after"]))
            for i, t in items]
    rows += [(9, "one x two y three z four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows)
    assert {(r[0], r[1]) for r in dc.find_overlaps(docs, bench).collect()} == {(i, i) for i in range(1, 5)}
    assert [r["doc_id"] for r in dc.without_contaminated(docs, bench).collect()] == [9]


def test_blocks_of_the_benchmark_change_nothing(spark, make_docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(prose(i, 25))) for i in range(30)], "item_id long, text string")
    docs = make_docs([(i, " ".join(prose(90 + i, 20) + prose(i, 25))) for i in range(30)])
    once = sorted(map(tuple, dc.find_overlaps(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, dc.find_overlaps(docs, bench).collect())) == once and len(once) == 30


# Licences


def brute_best(text, template):
    words = [w for w in map(licenses.normal, text.split()) if w]
    target = [w for w in map(licenses.normal, template.split()) if w]
    want = list(zip(target, target[1:]))
    best = 0.0
    for a in range(len(words)):
        for b in range(a + 2, len(words) + 1):
            left, shared = list(want), 0
            for pair in zip(words[a:b], words[a + 1:b]):
                if pair in left:
                    left.remove(pair)
                    shared += 1
            best = max(best, 2 * shared / (b - a - 1 + len(want)))
    return best


def test_licences_against_brute_force(make_docs, odd_rows):
    rng = random.Random(2)
    short = tuple(t for t in TEMPLATES if len(t[1].split()) < 15)
    rows = []
    for i in range(40):
        words = rng.choice(short)[1].split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["the", "License", "foo", "under"])
        rows.append((i, " ".join(prose(i, 5) + words + prose(i + 99, 5))))
    found = licenses.scan(make_docs(rows + odd_rows), short).collect()
    best = {}
    for r in found:
        at = r["doc_id"], r["template"]
        best[at] = max(best.get(at, 0), r["dice"])
    expected = {
        (i, t): value for i, text in rows for t, (_, template) in enumerate(short)
        if (value := brute_best(text, template)) >= licenses.DICE - 1e-12
    }
    assert best.keys() == expected.keys()
    assert all(math.isclose(best[k], expected[k]) for k in best)


def test_whole_licences_in_long_texts(make_docs):
    mit = TEMPLATES[4][1].replace("The above", "\n\nThe above").upper()
    rows = [(1, " ".join(prose(1, 50)) + "\n" + mit + "\n" + " ".join(prose(2, 50))), (2, mit * 2), (3, None)]
    found = [r for r in licenses.scan(make_docs(rows)).collect() if r["template"] == 4]
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(1, "MIT"), (2, "MIT"), (2, "MIT")]
    assert all(r["dice"] > 0.98 for r in found)
    assert licenses.scan(make_docs([])).collect() == []


def test_each_template_is_found_as_the_best_of_its_own_text(make_docs):
    rows = [(i, " ".join([*prose(i, 30), text, *prose(i + 50, 30)])) for i, (_, text) in enumerate(TEMPLATES)]
    found = licenses.scan(make_docs(rows)).collect()
    for i, (name, _) in enumerate(TEMPLATES):
        own = [r for r in found if r["doc_id"] == i]
        assert max(own, key=lambda r: (r["dice"], r["end_word"] - r["first_word"]))["license"] == name
        assert any(r["template"] == i and r["dice"] > 0.99 for r in own)


@pytest.mark.parametrize("notice", ["All rights reserved.", "Released under the MIT License."])
def test_repeated_notices_take_linear_time(notice):
    import time

    known, most = licenses.Templates(TEMPLATES, licenses.DICE), {}
    for n in (1_000, 100_000):
        began = time.thread_time()
        bigrams, _ = known.bigrams(f"{notice} " * n)
        own = [p for p in known.passages(bigrams) if TEMPLATES[p[0]][1] == notice]
        most[n] = time.thread_time() - began
        assert len(own) == n
    assert most[100_000] < 8


@pytest.mark.parametrize("pattern", [[1.0, -2.0], [1.0, -0.9], [3.0, -1.0, -1.0, 0.5], [-1.0, 1.0]])
def test_segments_take_linear_time(pattern):
    import time

    scores = np.array(pattern * (40_000 // len(pattern)))
    began = time.thread_time()
    found = toxicity.segments(scores)
    assert time.thread_time() - began < 0.5
    assert found and all(a < b and s > 0 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
