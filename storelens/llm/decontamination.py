"""Benchmark decontamination by spaced seeds.

A spaced seed hashes the tokens under the ones of a fixed mask and ignores those under its zeros,
so a changed token under a zero does no harm. The masks are chosen by enumeration: whichever tokens of
an overlap are changed, one of them fits its equal tokens somewhere. The seeds of the benchmark are looked up at every position of every
document. Each hit names a diagonal (a document and an item, one shifted along the other); around
it the longest stretch is taken that begins and ends with an equal token and has at least `similarity` of
them equal, and that counts if it is long enough or covers that share of a short item.

Tokens are words without case and outer punctuation. The benchmark goes to the tasks in blocks of about
BLOCK_BYTES, so what a task holds has a bound; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import Learned, texts

# By the least length of an overlap: in every stretch of that length or more with equal ends and at least
# COVERED of its tokens equal, one of the masks meets equal tokens only.
COVERED = 0.8
COVERS = {
    1: ("1",),
    2: ("11",),
    4: ("111", "1011"),
    5: ("1111", "10111", "11011", "11101"),
    6: ("10111", "111001"),
    7: ("11111", "110111", "1001111", "1101011"),
    8: ("11111", "110111", "11010011"),
    11: ("1011111", "1101111", "1111000101", "11000100111"),
    12: ("1101111", "1110111", "1101000111", "111010000011"),
}
MIN_OVERLAP, SIMILARITY = 13, 0.8
BLOCK_BYTES = 4 * 1024**2
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MULTIPLIERS = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)]


def token(word: bytes) -> int:
    """The hash of a word without case and outer punctuation; 0 if nothing is left."""
    low = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
    plain = low.strip(_EDGE)
    return xxhash.xxh64_intdigest(plain) or 1 if plain else 0


def tokens(text: bytes, known: Learned) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and the number of the word each came from."""
    words = text.split()
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(found)
    return found[at], at


def spaced(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position where the whole mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for k in (k for k, c in enumerate(mask) if c == "1"):
            total += hashes[k:k + n] * np.uint64(_MULTIPLIERS[k])
    return total


def least_overlap(n: int, min_overlap: int, similarity: float) -> int:
    """The tokens an overlap with an item of n tokens has at least."""
    return min(min_overlap, max(1, math.ceil(similarity * n - 1e-9)))


def masks_for(least: int, similarity: float) -> tuple[str, ...]:
    """Masks of which one hits every stretch of `least` or more tokens with that share equal."""
    if similarity >= COVERED:
        return COVERS[max(k for k in COVERS if k <= max(1, least))]
    unequal = [(n, math.floor((1 - similarity) * n + 1e-9)) for n in range(least, least + 200)]
    return ("1" * max(1, min(math.ceil((n - u) / (u + 1)) for n, u in unequal)),)  # the longest equal run


class Index:
    """The seeds of one block of items, by mask."""

    def __init__(
        self, items: list[tuple[int, bytes]], min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY
    ):
        known = Learned(token)
        self.ids = [i for i, _ in items]
        self.items = [tokens(t, known) for _, t in items]
        found: dict[str, list] = {}
        for number, (item, _) in enumerate(self.items):
            if not len(item):
                continue
            for mask in masks_for(least_overlap(len(item), min_overlap, similarity), similarity):
                seeds = spaced(item, mask)
                found.setdefault(mask, []).append(
                    (seeds, np.full(len(seeds), number), np.arange(len(seeds))))
        self.masks = {}
        for mask, parts in found.items():
            seeds, number, at = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[(seeds >> np.uint64(44)).astype(np.int64)] = True
            self.masks[mask] = seeds[order], number[order], at[order], maybe

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, position in the item) of every seed met, over all masks."""
        for mask, (seeds, number, at, maybe) in self.masks.items():
            found = spaced(hashes, mask)
            places = np.flatnonzero(maybe[(found >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(seeds, found[places], "left")
            high = np.searchsorted(seeds, found[places], "right")
            for place, a, b in zip(
                places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()
            ):
                for k in range(a, b):
                    yield place, int(number[k]), int(at[k])


def longest_stretch(equal: np.ndarray, similarity: float, closed: bool = False) -> tuple[int, int]:
    """(first, end) of the longest stretch with at least that share of equal places, the first if
    several are as long; it begins and ends with an equal place. With `closed` only such stretches are
    compared, otherwise unequal places at the ends of the longest are left out afterwards."""
    height = np.r_[0.0, np.cumsum(np.where(equal, 1 - similarity, -similarity))]
    starts, low = [], math.inf
    for i, h in enumerate(height.tolist()):
        if h < low and not (closed and (i == len(equal) or not equal[i])):
            low = h
            starts.append(i)
    best = (0, 0)
    for end in range(len(height) - 1, 0, -1):
        if closed and not equal[end - 1]:
            continue
        while starts and height[starts[-1]] <= height[end] + 1e-9:
            first = starts.pop()
            if end - first > best[1] - best[0] or (
                end - first == best[1] - best[0] and first < best[0]):
                best = first, end
    first, end = best
    inside = np.flatnonzero(equal[first:end])
    return (first + int(inside[0]), first + int(inside[-1]) + 1) if len(inside) else (0, 0)


def overlaps(
    index: Index, hashes: np.ndarray, min_overlap: int, similarity: float
) -> Iterator[tuple[int, int, int, int, int]]:
    """(item number, first, end, first in the item, equal tokens) of each verified diagonal."""
    seen: set[tuple[int, int]] = set()
    for place, number, at in index.hits(hashes):
        if (number, place - at) in seen:
            continue
        seen.add((number, place - at))
        item = index.items[number][0]
        shift = place - at
        a, b = max(0, -shift), min(len(item), len(hashes) - shift)
        equal = hashes[a + shift:b + shift] == item[a:b]
        first, end = longest_stretch(equal, similarity, closed=True)
        if end - first >= least_overlap(len(item), min_overlap, similarity):
            yield number, a + first + shift, a + end + shift, a + first, int(equal[first:end].sum())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about BLOCK_BYTES each."""
    items = benchmark.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    ).where(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        yield sorted(((r["id"], r["text"].encode()) for r in rows), key=lambda r: (r[0] is None, r))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_overlap: int = MIN_OVERLAP,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each document, item and diagonal with a verified overlap.

    id, item id, doc_start and doc_end (words of the document), item_start and item_end (words of the item),
    n_tokens and n_equal. An overlap has min_overlap tokens, or `similarity` of an item's if the item is
    shorter. Null and empty texts and items of punctuation alone overlap with nothing. Repeated documents
    and items have rows of their own; null ids stay null. Either table empty: no rows. Other columns are ignored.
    """
    schema = (
        f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} long, doc_start long,"
        " doc_end long, item_start long, item_end long, n_tokens long, n_equal long"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col):

        def run(batches, items=items):
            index, known = Index(items, min_overlap, similarity), Learned(token)
            for batch in batches:
                owner, out = [], []
                for row, text in enumerate(texts(batch.column(1))):
                    hashes, words = tokens(text, known)
                    for number, a, b, first, equal in overlaps(
                        index, hashes, min_overlap, similarity
                    ):
                        item_words = index.items[number][1]
                        owner.append(row)
                        out.append((
                            index.ids[number], int(words[a]), int(words[b - 1]) + 1,
                            int(item_words[first]), int(item_words[first + b - a - 1]) + 1,
                            b - a, equal))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)),
                         *(pa.array(c, pa.int64()) for c in zip(*out))], names)

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_overlap: int = MIN_OVERLAP,
    similarity: float = SIMILARITY,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item (as find_overlaps has it)."""
    kept, place = docs, docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col):

        def run(batches, items=items):
            index, known = Index(items, min_overlap, similarity), Learned(token)
            for batch in batches:
                keep = [
                    next(overlaps(index, tokens(t, known)[0], min_overlap, similarity), None) is None
                    for t in texts(batch.column(place))
                ]
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
