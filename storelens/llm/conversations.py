"""Repair of conversation structure by dynamic programming over a grammar.

A conversation is the sequence of its rows' symbols: the initial of the role and the row's first fault. Its cheapest
edits into system? (user assistant)+, or nothing, are a product of transfer matrices, one a symbol, over the states
of that pattern, in the algebra of (cost, audit): costs add and audits are joined, and the smaller cost, then
the audit that is less in ASCII, wins. The product is associative, so Re-Pair rules can stand for
stretches: the most frequent neighbours of all conversations become a new symbol, again and again, and each rule's
matrix is computed once, bottom-up from the two it replaces, and shared by all conversations. Audits inside
rules are ropes: two halves and a hash, compared without being written out.

Inserts are counted with the row they stand before. Then all audits of a stretch end with a row, none is the beginning
of another, and the least one of a whole is made of the least ones of its parts.

A conversation of any length is cut into blocks of consecutive rows, whose matrices are computed anywhere and
multiplied in order. Ranks come from a sort over the cluster, first occurrences from a grouped minimum. Only the
digest of a repaired conversation is made by one task, which reads its rows as a stream: SHA-256 allows nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.ranking import global_rank
from storelens.llm.common import Learned, map_batches
from storelens.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4096  # rows of a conversation in one block
ROUNDS, MOST_RULES, LEAST_SHARE = 24, 512, 1e-4
INITIALS = "sua"

#: Symbol 0 is a row to be deleted; then the initials s, u, a and any other, sound and then truncated.
GONE, TERMINALS = 0, 9
#: States: nothing yet, after system, after user, after assistant. What may come next, by initial.
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)

_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A text in two halves, with its length and hash; halves are shared."""

    __slots__ = ("left", "right", "text", "size", "hash")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MODULUS
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MODULUS) + right.hash) % _MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        return Rope(left=self, right=other) if self.size else other

    def halves(self) -> tuple[Rope, Rope]:
        if self.left is None:
            return Rope(self.text[:1]), Rope(self.text[1:])  # never asked of fewer than two characters
        return self.left, self.right

    def __str__(self) -> str:
        parts, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                parts.append(rope.text)
            else:
                stack += [rope.right, rope.left]
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        if not self.size or not other.size:
            return self.size < other.size
        mine, yours = [self], [other]
        while mine and yours:
            a, b = mine.pop(), yours.pop()
            if a is b or (a.size == b.size and a.hash == b.hash):
                continue
            if a.size == b.size == 1:
                return str(a) < str(b)
            if a.size >= b.size:
                mine += a.halves()[::-1]
            else:
                mine.append(a)
            if b.size >= a.size:
                yours += b.halves()[::-1]
            else:
                yours.append(b)
        return bool(yours)  # one is the beginning of the other

    def __reduce__(self):
        return Rope, (self.text, self.left, self.right)


Matrix = list  # STATES rows of STATES entries: None or (cost, rope)


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: from state p through a and then b to state q."""
    out = []
    for row in a:
        new: list = [None] * STATES
        for (entry, after) in zip(row, b):
            if entry is not None:
                for q, more in enumerate(after):
                    if more is not None and (new[q] is None or entry[0] + more[0] <= new[q][0]):
                        new[q] = _better((entry[0] + more[0], entry[1] + more[1]), new[q])
        out.append(new)
    return out


def inserts() -> Matrix:
    """Any number of inserted rows, of which more than two never pay."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        state = p
        for n in range(3):
            out[p][state] = _better(out[p][state], (n * INSERT, Rope("I" * n)))
            state = 3 if state == 2 else 2
    return out


def transfer(symbol: int) -> Matrix:
    """What the row of a symbol can become, with the rows inserted before it."""
    initial = (INITIALS + "o")[(symbol - 1) % 4]
    extra = TRUNCATED if symbol > 4 else 0
    ops: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        ops[p][p] = (DELETE, Rope("D"))
        if symbol != GONE:
            for to, q in NEXT[p].items():
                if to == initial:
                    ops[p][q] = _better(ops[p][q], (KEEP + extra, Rope("K")))
                if to != "s":
                    ops[p][q] = _better(ops[p][q], (REROLE + extra, Rope("R")))
    return times(inserts(), ops)


def matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """The matrix of every symbol: terminals first, then each rule from the two it replaces."""
    out = [transfer(s) for s in range(TERMINALS)]
    for a, b in rules:
        out.append(times(out[a], out[b]))
    return out


def compressed(symbols: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """symbols, in which -1 separates sequences, with the rules applied in order, from left to right."""
    for number, (a, b) in enumerate(rules):
        at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
        if not len(at):
            continue
        if a == b:
            at = at[_even_in_run(at)]
        symbols[at] = TERMINALS + number
        symbols = np.delete(symbols, at + 1)
    return symbols


def _even_in_run(at: np.ndarray) -> np.ndarray:
    """Which of the sorted places are the first, third, fifth... of their run of consecutive places."""
    new = np.r_[True, np.diff(at) != 1]
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (np.arange(len(at)) - begin) % 2 == 0


def _joined(sequences: list[bytes]) -> np.ndarray:
    """Sequences of one byte a symbol, one after the other, with -1 after each."""
    sizes = np.array([len(s) + 1 for s in sequences], np.int64)
    out = np.full(sizes.sum(), -1, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = np.frombuffer(b"".join(sequences), np.uint8)
    return out


def grammar(sequences: DataFrame) -> list[tuple[int, int]]:
    """Re-Pair rules for rows (symbols, n) of distinct sequences and how often each occurs.

    Every round counts the neighbours of all sequences and makes rules of the most frequent pairs that share no
    symbol. A pair in less than LEAST_SHARE of all places is left alone; so is all after MOST_RULES rules. Rules
    only save work: without any, the result is the same.
    """
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        now, width = list(rules), TERMINALS + len(rules)

        def count(batches, now=now, width=width):
            total: dict[int, int] = {}
            for batch in batches:
                line = _joined(batch.column(0).to_pylist())
                weight = np.repeat(
                    batch.column(1).to_numpy(), [len(s.as_py()) + 1 for s in batch.column(0)])
                # a weight travels with the first symbol of what a rule replaces
                tagged = compressed(line.copy(), now)
                ends = np.flatnonzero(tagged == -1)
                sizes = np.diff(np.r_[-1, ends])
                weight = np.repeat(weight[np.flatnonzero(line == -1)], sizes)
                at = np.flatnonzero((tagged[:-1] >= 0) & (tagged[1:] >= 0))
                same = tagged[at] == tagged[at + 1]
                keep = np.ones(len(at), bool)
                twins = np.flatnonzero(same)
                if len(twins):
                    keep[twins] = _even_in_run(at[twins])
                at = at[keep]
                pair = tagged[at].astype(np.int64) * width + tagged[at + 1]
                codes, where = np.unique(pair, return_inverse=True)
                sums = np.zeros(len(codes), np.int64)
                np.add.at(sums, where, weight[at])
                for code, n in zip(codes.tolist(), sums.tolist()):
                    total[code] = total.get(code, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        counted = sequences.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = counted.collect()  # at most the square of the symbols so far
        places = sum(r["n"] for r in found)
        used: set[int] = set()
        for pair, n in sorted(((r["pair"], r["n"]) for r in found), key=lambda p: (-p[1], p[0])):
            a, b = divmod(pair, width)
            if n < max(2, LEAST_SHARE * places) or len(rules) == MOST_RULES:
                break
            if not {a, b} & used:
                used |= {a, b}
                rules.append((a, b))
        if len(rules) == len(now):
            break
    return rules


# Rows


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and mark (a hash of role and text); null roles and texts are one space."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
        .alias("mark"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def _blocks(rows: DataFrame) -> DataFrame:
    """conv, block, symbols and counts of each block of consecutive rows."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = materialize(rows.select(
        "conv", "turn", "role", "mark", kind.alias("kind"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        # equal rows of a turn need an order too, or they would all be sorted in one task
        F.monotonically_increasing_id().alias("at"),
    ), "conversations-rows")
    ranked = global_rank(
        narrow, [F.col("conv").asc_nulls_first(), *_order(), F.col("at")], "rank", "conversations-rank"
    ).select("conv", "turn", "mark", "kind", "blank", "cut", "rank")
    # the first of equal rows of a conversation; a rank is a key without repeats
    first = ranked.groupBy("conv", "mark").agg(F.min("rank").alias("rank")).select(
        "rank", F.lit(True).alias("first"))
    told = ranked.join(first, "rank", "left").select(
        "conv", F.expr(f"rank div {BLOCK}").alias("block"),
        F.struct("rank", "turn", "kind", "blank", "cut", F.col("first").isNotNull().alias("first")).alias("row"))
    grouped = told.groupBy("conv", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # BLOCK at most
    kind = grouped.schema["conv"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(2)
        flat = lists.flatten()
        field = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "blank", "cut", "first")}
        turn = flat.field("turn")
        absent = turn.is_null().to_numpy(zero_copy_only=False)
        turn = turn.fill_null(0).to_numpy(zero_copy_only=False)
        blank = field["blank"].astype(bool)
        again = ~blank & ~field["first"].astype(bool)
        cut = ~blank & ~again & field["cut"].astype(bool)
        kinds = field["kind"].astype(np.int64)
        symbol = np.where(blank | again, GONE, 1 + kinds + 4 * cut).astype(np.uint8)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        out = []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            turns = turn[a:b][~absent[a:b]]
            pairs = list(zip(kinds[a:b - 1].tolist(), kinds[a + 1:b].tolist()))
            out.append((
                symbol[a:b].tobytes(), int(blank[a:b].sum()), int(again[a:b].sum()), int(cut[a:b].sum()),
                sum(p not in _LEGAL for p in pairs), int(kinds[a]), int(kinds[b - 1]),
                int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None,
                int((np.diff(turns) != 0).sum()) + 1 if len(turns) else 0))
        columns = list(zip(*out)) if out else [()] * len(_BLOCK_FIELDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             *[pa.array(c, t) for c, (_, t) in zip(columns, _BLOCK_FIELDS)]],
            ["conv", "block", *[n for n, _ in _BLOCK_FIELDS]])

    return map_batches(
        grouped, run, f"conv {kind}, block long, symbols binary, "
        + ", ".join(f"{n} long" for n, _ in _BLOCK_FIELDS[1:]))


_LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au
_BLOCK_FIELDS = [("symbols", pa.binary()), *[
    (n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "kind_from", "kind_to",
                              "turn_from", "turn_to", "turns")]]


class Evaluator:
    """Costs and audits of sequences of symbols; one for each task, so it remembers what it has met."""

    def __init__(self, rules: list[tuple[int, int]], shared: list[Matrix]):
        self.rules, self.matrices = rules, shared
        self.known = Learned(self._product, most=20_000)

    def _product(self, symbols: bytes) -> tuple[list[int | None], list[str | None]]:
        numbers = np.frombuffer(symbols, np.int32).tolist()
        whole = self.matrices[numbers[0]]
        for number in numbers[1:]:
            whole = times(whole, self.matrices[number])
        entries = [e for row in whole for e in row]
        return [e and e[0] for e in entries], [e and str(e[1]) for e in entries]

    def __call__(self, sequences: list[bytes]) -> list[tuple[list, list]]:
        line = compressed(_joined(sequences), self.rules)
        ends = np.flatnonzero(line == -1).tolist()
        return [self.known[line[a:b].tobytes()] for a, b in zip([0, *[e + 1 for e in ends]], ends)]


def _evaluated(blocks: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """blocks with costs and audits, from each state to each, in place of their symbols."""
    shared = matrices(rules)
    state: dict[str, Evaluator] = {}
    names = [n for n in blocks.columns if n != "symbols"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not state:
            state["evaluator"] = Evaluator(rules, shared)
        found = state["evaluator"](batch.column("symbols").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names],
             pa.array([f[0] for f in found], pa.list_(pa.int64())),
             pa.array([f[1] for f in found], pa.list_(pa.string()))],
            [*names, "costs", "audits"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "symbols")
    return map_batches(blocks, run, f"{kept}, costs array<long>, audits array<string>")


class _Fold:
    """The blocks of one conversation, one after the other."""

    def __init__(self):
        self.vector: list = [(0, Rope()), *[None] * (STATES - 1)]
        self.counts = [0, 0, 0, 0]
        self.kind = self.turn_from = self.turn_to = None
        self.turns = 0

    def add(self, row: dict) -> None:
        entries = [None if c is None else (c, Rope(a)) for c, a in zip(row["costs"], row["audits"])]
        block = [entries[p * STATES:(p + 1) * STATES] for p in range(STATES)]
        self.vector = times([self.vector], block)[0]
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[name]
        if self.kind is not None and (self.kind, row["kind_from"]) not in _LEGAL:
            self.counts[3] += 1
        self.kind = row["kind_to"]
        if row["turn_from"] is not None:
            self.turns += row["turns"] - (self.turn_to == row["turn_from"])
            self.turn_from = row["turn_from"] if self.turn_from is None else self.turn_from
            self.turn_to = row["turn_to"]

    def result(self) -> tuple:
        end = times([self.vector], inserts())[0]
        cost, audit = _better(*[end[q] for q in ACCEPTED])
        gaps = 0 if self.turn_to is None else self.turn_to - self.turn_from + 1 - self.turns
        return (gaps, *self.counts, cost, str(audit))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _folded(evaluated: DataFrame) -> DataFrame:
    """conv, its counts, cost and audit; the blocks of a conversation pass one task as a stream."""
    kind = evaluated.schema["conv"].dataType.simpleString()

    def run(batches):
        now, fold = None, None
        done: list[tuple] = []

        def out():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], conv_type), *[pa.array(c, pa.int64()) for c in columns[1:7]],
                 pa.array(columns[7], pa.string())], ["conv", *COUNTS, "audit"])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if fold is None or row["conv"] != now:
                    if fold is not None:
                        done.append((now, *fold.result()))
                    now, fold = row["conv"], _Fold()
                fold.add(row)
            if len(done) >= 1000:
                yield out()
                done.clear()
        if fold is not None:
            done.append((now, *fold.result()))
            yield out()

    ordered = evaluated.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "block")
    return ordered.mapInArrow(run, f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


def _digested(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """folded with the digest of each repaired conversation, made from its rows as a stream."""
    kind = folded.schema["conv"].dataType.simpleString()
    head = folded.withColumns({
        "turn": F.lit(None).cast("bigint"), "role": F.lit(None).cast("string"),
        "text": F.lit(None).cast("string"), "mark": F.lit(None).cast("binary"), "part": F.lit(0)})
    body = rows.withColumns({
        **{c: F.lit(None).cast("bigint") for c in COUNTS}, "audit": F.lit(None).cast("string"),
        "part": F.lit(1)}).select(head.columns)
    ordered = head.unionByName(body).repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), "part", *_order())
    names = ["conv", *COUNTS, "audit"]

    def run(batches):
        writer: Repaired | None = None
        head: dict = {}
        done: list[tuple] = []
        types = None

        def out():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(columns, types)], pa.array(columns[-1], pa.string())],
                [*names, "repaired_sha256"])

        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if writer is not None:
                        done.append((*[head[n] for n in names], writer.digest()))
                    writer, head = Repaired(row["audit"]), row
                else:
                    writer.add(row["role"], row["text"])
            if len(done) >= 1000:
                yield out()
                done.clear()
        if writer is not None:
            done.append((*[head[n] for n in names], writer.digest()))
            yield out()

    return ordered.select(*names, "turn", "role", "text", "mark", "part").mapInArrow(
        run, f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


class Repaired:
    """The lines of a repaired conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.sha, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.state = NEXT[self.state][role[0]]
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.line("assistant" if self.state == 2 else "user", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
        elif edit == "R":
            self.line("assistant" if self.state == 2 else "user", text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def damaged(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The four columns of every row, damaged by the CRC-32 of `conv:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role
    user. Nulls count as one space in the key and become one in role and text.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rest = F.crc32(key.cast("binary")) % 20
    kept = F.coalesce(text.cast("string"), space)
    return (
        rows.where(rest != 0)
        .select(
            conv.alias("_conv"), turn.alias("_turn"),
            F.when(rest == 4, "user").otherwise(F.coalesce(role.cast("string"), space)).alias("_role"),
            F.when(rest == 1, "").when(rest == 2, F.translate(kept, ".!?", "")).otherwise(kept).alias("_text"),
            F.explode(F.when(rest == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .select(
            F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col),
            F.col("_text").alias(text_col))
    )


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", everyone: DataFrame | None = None,
) -> DataFrame:
    """One row a conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; those of one turn by role and a hash of role and text. A null role or text is one
    space, a null conversation is one conversation. Equal rows: all but the first are duplicates. Texts are
    taken whole. `everyone` may name more conversations in its column conv_col: those without rows get zeros, an
    empty audit and the digest of nothing. Other columns are ignored. Empty table: no rows.
    """
    plain = _rows(rows, conv_col, turn_col, role_col, text_col)
    blocks = materialize(_blocks(plain), "conversations-blocks")
    distinct = materialize(
        blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "conversations-distinct")
    rules = grammar(distinct)
    folded = materialize(_folded(_evaluated(blocks, rules)), "conversations-folded")
    found = _digested(plain, folded)
    names = [*COUNTS, "audit", "repaired_sha256"]
    if everyone is not None:
        nothing = everyone.select(F.col(f"`{conv_col}`").alias("conv")).distinct().select(
            "conv", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS], F.lit("").alias("audit"),
            F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"), F.lit(False).alias("has_rows"))
        both = found.withColumn("has_rows", F.lit(True)).unionByName(nothing)
        found = both.groupBy("conv").agg(F.max(F.struct("has_rows", *names)).alias("f")).select("conv", "f.*")
    return found.select(F.col("conv").alias(conv_col), *names)


#: The same in DuckDB for the damaged table: a row at a time, the best of each state goes on.
REPAIR_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations),
rested AS (
    SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
        lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) % 20 AS rest
    FROM keyed, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN rest = 4 THEN 'user' ELSE role END AS role,
           CASE rest WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN rest = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM rested WHERE rest <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                                 md5(strlen(role) || ':' || role || text), copy) AS pos
    FROM damaged),
seen AS (
    SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
           NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
    FROM placed),
faulty AS (
    SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault,
           lag(c) OVER (PARTITION BY conv_id ORDER BY pos) || c AS pair
    FROM seen),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
    FROM faulty GROUP BY conv_id),
ins(p, q, cost, audit, line) AS (VALUES
    (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 3, 'I', E'user:\n'), (1, 2, 3, 'I', E'user:\n'), (3, 2, 3, 'I', E'user:\n'), (2, 3, 3, 'I', E'assistant:\n'),
    (0, 3, 6, 'II', E'user:\nassistant:\n'), (1, 3, 6, 'II', E'user:\nassistant:\n')),
emits(p, q, c, role) AS (VALUES
    (0, 1, 's', ''), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
op AS (
    SELECT conv_id, pos, p, p AS q, 4 AS cost, 'D' AS audit, '' AS line FROM faulty, (VALUES (0), (1), (2), (3)) s(p)
    UNION ALL
    SELECT conv_id, pos, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', faulty.role || ':' || text || chr(10)
    FROM faulty JOIN emits USING (c) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT conv_id, pos, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', emits.role || ':' || text || chr(10)
    FROM faulty, emits WHERE emits.c <> 's' AND fault NOT IN ('blank', 'duplicate')),
move AS (
    SELECT conv_id, pos, ins.p, op.q, ins.cost + op.cost AS cost, ins.audit || op.audit AS audit,
           ins.line || op.line AS line
    FROM ins JOIN op ON op.p = ins.q),
path(conv_id, pos, q, cost, audit, line) AS (
    SELECT conv_id, 0, 0, 0, '', '' FROM counted
    UNION ALL
    SELECT conv_id, pos, q, b.cost, b.audit, b.line FROM (
        SELECT move.conv_id, move.pos, move.q, min({'cost': path.cost + move.cost, 'audit': path.audit || move.audit,
                                                   'line': path.line || move.line}) AS b
        FROM path JOIN move ON move.conv_id IS NOT DISTINCT FROM path.conv_id AND move.pos = path.pos + 1
                           AND move.p = path.q
        GROUP BY ALL)),
ended AS (
    SELECT path.conv_id, min({'cost': path.cost + ins.cost, 'audit': path.audit || ins.audit,
                              'line': path.line || ins.line}) AS b
    FROM path JOIN counted ON counted.conv_id IS NOT DISTINCT FROM path.conv_id AND path.pos = n
    JOIN ins ON ins.p = path.q
    WHERE ins.q IN (0, 3) GROUP BY path.conv_id),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT everyone.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit,
       sha256(CASE WHEN b.line IS NULL OR b.line = '' THEN '' ELSE left(b.line, length(b.line) - 1) END) AS repaired_sha256
FROM everyone
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM everyone.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM everyone.conv_id
"""

