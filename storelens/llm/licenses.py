"""Licence scan: passages of a text against licence templates by Dice over word bigrams.

Text and templates are normalised alike (case, outer punctuation, one spelling of licence) and cut
into word bigrams. The Dice coefficient of a passage A and a template B, bigrams counted with repeats, is
2 |A and B| / (|A| + |B|). For it to reach t, the passage must have t / (2 - t) |B| to
(2 - t) / t |B| bigrams, and share at least t / (2 - t) |B| of them. These bounds rule a template out wherever too
few of its bigrams lie close enough together, by counting alone; only what is left is compared.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import Learned
from storelens.llm.license_templates import TEMPLATES

DICE = 0.8
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»©"


def normal(word: str) -> str:
    return word.lower().strip(_EDGE).replace("licence", "license")


class Templates:
    """The bigrams of all templates as numbers, and who has which."""

    def __init__(self, templates: tuple[tuple[str, str], ...], dice: float):
        self.names = [name for name, _ in templates]
        split = [[w for w in map(normal, text.split()) if w] for _, text in templates]
        words = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(words, 1)}
        self.known = Learned(lambda w: number.get(normal(w), 0) if normal(w) else -1)
        coded = [[(number[a], number[b]) for a, b in zip(ws, ws[1:])] for ws in split]
        self.pairs = np.full((len(words) + 1, len(words) + 1), -1, np.int32)
        for a, b in sorted({p for c in coded for p in c}):
            self.pairs[a, b] = self.pairs.max() + 1
        self.bags = [Counter(int(self.pairs[p]) for p in c) for c in coded]
        self.sizes = [len(c) for c in coded]
        self.has = np.zeros((len(templates), self.pairs.max() + 1), bool)
        for t, bag in enumerate(self.bags):
            self.has[t, list(bag)] = True
        self.least = [math.ceil(dice / (2 - dice) * n - 1e-9) for n in self.sizes]
        self.most = [math.floor((2 - dice) / dice * n + 1e-9) for n in self.sizes]
        self.dice = dice

    def bigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of each bigram (-1: in no template) and the word at which it begins; the word
        after the last one closes the second array."""
        words = text.split()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        ids = ids[at]
        return self.pairs[ids[:-1], ids[1:]], at

    def passages(self, bigrams: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(template, first bigram, end bigram, dice), not overlapping for one template, the best
        first: ties to the longer and then the earlier one."""
        met = np.flatnonzero(bigrams >= 0)
        if not len(met):
            return
        for t in np.flatnonzero(self.has[:, bigrams[met]].sum(axis=1) >= self.least):
            places = met[self.has[t, bigrams[met]]]
            k = max(1, self.least[t])
            if self.sizes[t] == 0:
                continue
            found = []
            bag, size, least, most = self.bags[t], self.sizes[t], self.least[t], self.most[t]
            at, numbers = places.tolist(), bigrams[places].tolist()
            # a start counts only if enough of the template's bigrams follow close enough
            starts = np.flatnonzero(places[k - 1:] - places[: len(places) - k + 1] < most)
            for i in starts.tolist():
                used: dict[int, int] = {}
                first, shared, best = at[i], 0, None
                for j in range(i, min(i + most, len(at))):  # at most a bounded number of bigrams for each start
                    long = at[j] - first + 1
                    if long > most:
                        break
                    met_before = used.get(numbers[j], 0)
                    if met_before < bag[numbers[j]]:
                        used[numbers[j]] = met_before + 1
                        shared += 1
                    if shared < least:
                        continue
                    value = 2 * shared / (long + size)
                    if value >= self.dice - 1e-12 and (best is None or value >= best[0]):
                        best = value, long, first, at[j] + 1
                if best:
                    found.append(best)
            taken = bytearray(len(bigrams))
            for value, _, first, end in sorted(found, key=lambda f: (-f[0], -f[1], f[2])):
                if taken.find(1, first, end) < 0:
                    taken[first:end] = b"\x01" * (end - first)
                    yield int(t), first, end, value


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    dice: float = DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, license, template (its place in the list), first_word, end_word and dice of each match.

    Every passage of the whole text with a Dice coefficient of at least `dice` to a template counts; of
    overlapping ones for the same template the best. Different templates may match the
    same words. A narrow map: rows of docs without a match have none here, repeated
    rows have theirs repeated, null ids stay null. Null and empty texts, texts of one word, and templates of one
    word match nothing. Other columns are ignored.
    """
    fields = ["id", "license", "template", "first_word", "end_word", "dice"]

    def run(batches):
        known = Templates(templates, dice)
        for batch in batches:
            owner, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                bigrams, at = known.bigrams(text)
                for t, first, end, value in known.passages(bigrams):
                    owner.append(row)
                    out.append((known.names[t], t, int(at[first]), int(at[end]) + 1, value))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(columns[0], pa.string()),
                     pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())], fields)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(
        run, f"id {kind}, license string, template int, first_word long, end_word long, dice double"
    ).withColumnRenamed("id", id_col)
