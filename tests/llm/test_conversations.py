"""Conversation repair against a search over all edits, with odd rows and conversations over many blocks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from storelens.llm import conversations
from tests.llm.conftest import prose

SCHEMA = "conv_id long, turn long, role string, text string, audit string, mark string, block long, rank long"
VALID = re.compile(r"(s?(ua)+)?")


def order(row):
    _, turn, role, text = row
    mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role.encode(), mark)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = ("blank" if not words else "duplicate" if (role, text) in seen
                 else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(fault)
    return out


def best(rows):
    """(cost, audit, lines) of the cheapest edits: a row at a time, the best for each way to go on."""
    states = {"": (0, "", ())}  # by the roles so far, as far as they matter

    def after(state, c):
        whole = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        return whole[state].get(c)

    def inserted(found):
        out = dict(found)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    to = after(state, c)
                    if to:
                        new = (cost + 3, audit + "I", (*lines, f"{role}:"))
                        out[to] = min(out.get(to, new), new)
        return out

    for (_, _, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for state, (cost, audit, lines) in inserted(states).items():
            options = [(state, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                options.append((after(state, role[:1] or "?"), (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    options.append((after(state, c), (cost + 3 + extra, audit + "R", (*lines, f"{name}:{text}"))))
            for to, option in options:
                if to is not None:
                    new[to] = min(new.get(to, option), option)
        states = new
    ends = inserted(states)
    return min(ends[s] for s in ("", "a") if s in ends)


def expected(rows, everyone):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = set()
    for conv in set(everyone) | {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        cost, audit, lines = best(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        kinds = faults(mine)
        out.add((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"),
            kinds.count("duplicate"), kinds.count("truncated"),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def some_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u"]
    texts = ["", " \t", "one.", "two", "three!", "four?  \n", None, "é.", "x\x1c", *prose(conv or 0, 8)]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_best_is_the_least_of_all_edits():
    """The expectation itself, against every edit of short conversations."""
    rng = random.Random(5)
    for _ in range(25):
        rows = [(1, i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c.", "d?"]))
                for i in range(rng.randrange(1, 4))]
        kinds, options = faults(rows), []
        for edits in itertools.product("DKua", repeat=len(rows)):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                cost, roles, audit = 0, "", ""
                for i, gap in enumerate(gaps):
                    cost, roles, audit = cost + 3 * len(gap), roles + gap, audit + "I" * len(gap)
                    if i == len(rows):
                        break
                    if edits[i] == "D":
                        cost, audit = cost + 4, audit + "D"
                        continue
                    if kinds[i] in ("blank", "duplicate"):
                        cost = 10**6
                    cost += 3 * (kinds[i] == "truncated") + 3 * (edits[i] != "K")
                    roles += rows[i][2][0] if edits[i] == "K" else edits[i]
                    audit += "K" if edits[i] == "K" else "R"
                if VALID.fullmatch(roles):
                    options.append((cost, audit))
        assert best(rows)[:2] == min(options)


@pytest.mark.parametrize("block", [4096, 7])
def test_repair_is_the_cheapest_edit(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(9)
    rows = [r for c in [None, *range(60)] for r in some_rows(rng, c, rng.randrange(1, 9))]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 5 else "no end") for i in range(300)]
    rows += [(98, 5, "user", "the same.")] * 150  # one turn of equal rows
    rows += some_rows(rng, 97, 120)
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    everyone = spark.createDataFrame([(i,) for i in (None, 7, 97, 500, 501, 501)], "conv_id long")
    found = [tuple(r) for r in conversations.repair(df, everyone=everyone).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected(rows, [None, 7, 97, 500, 501])


def test_rules_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [r for c in range(40) for r in some_rows(rng, c, 12)]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    with_rules = {tuple(r) for r in conversations.repair(df).collect()}
    monkeypatch.setattr(conversations, "MOST_RULES", 0)
    assert {tuple(r) for r in conversations.repair(df).collect()} == with_rules == expected(rows, [])


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes! No? So.") for c in range(30) for t in (None, 0, 1, 2)]
    rows += [(None, 3, None, None), (None, None, "system", None)]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    wanted = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        rest = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(rest, text)
        wanted += [(c, t, "user" if rest == 4 else role, text)] * {0: 0, 3: 2}.get(rest, 1)
    found = [tuple(r) for r in conversations.damaged(df).collect()]
    key = lambda r: str(r)
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(df, everyone=df).collect() == []
    one = spark.createDataFrame([(4,)], "conv_id long")
    assert [tuple(r) for r in conversations.repair(df, everyone=one).collect()] == [
        (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_ropes_compare_as_their_texts():
    rng = random.Random(1)
    ropes = [conversations.Rope(t) for t in ("K", "D", "R", "I", "KD", "IIK", "")]
    for _ in range(300):
        a, b = rng.choice(ropes), rng.choice(ropes)
        ropes += [a + b] if a.size + b.size < 60 else []
    for _ in range(3000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b))
        assert a.size == len(str(a))


def test_pairs_are_replaced_from_the_left():
    line = np.array([1, 1, 1, -1, 1, 1, 2, 2, 2, 2, -1], np.int32)
    assert conversations.compressed(line, [(1, 1), (2, 2)]).tolist() == [9, 1, -1, 9, 10, 10, -1]
