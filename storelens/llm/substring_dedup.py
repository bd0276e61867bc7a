"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least, in a hashed order, of the runs of
SEED words inside it, and consecutive windows mostly share one. Such a stretch of windows travels as one packed
string (its words, joined by spaces) to the bucket of its minimiser, so a word is sent about three
times and not once for each of its 20 windows. Equal windows have equal minimisers and meet in one
bucket, where sorting finds each window's first place exactly: hashes only bring candidates
together, and words decide. What comes back are the stretches to be removed.

Skew. A stretch that a task has met before with a smaller place is known to be repeated without being sent, so a
passage shared by any number of documents arrives once for each chunk of text, not once for each document.
Word runs that make up more than a 100,000th of a sample are put last in the minimiser order:
windows around a common passage then meet by their rarer words. The sample steers
where windows meet and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.skew import left_join
from storelens.llm.common import Learned, bounded_batches, chunks, map_batches, released, texts
from storelens.llm.simhash import mixed
from storelens.session import materialize

WINDOW, SEED = 20, 4
BUCKET_BYTES = 8 * 1024**2  # of packed words in a bucket, about
PACK_BYTES, BATCH_BYTES = 2 * 1024**2, 2 * 1024**2  # of text packed at a time, and sent to Python at a time
COMMON_SHARE, COMMON_LEAST, SAMPLE_OF = 1e-5, 16, 64
_REMEMBERED = 100_000
_ODD = 0x9E3779B97F4A7C15 | 1
NO_ID = -(2**63)  # stands for a null id, before all others


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every `length` consecutive values, modulo 2**64."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _ODD, np.uint64))
        power *= values
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(power, out=total[1:])
        sums = total[length:] - total[:-length]
        del power, total
        sums *= np.cumprod(np.full(n - length + 1, pow(_ODD, -1, 1 << 64), np.uint64))
        return mixed(sums, 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def seeds(hashes: np.ndarray) -> np.ndarray:
    return rolling(hashes, SEED)


class Common:
    """Whether seeds are among the common ones; a small table rules most of them out."""

    def __init__(self, common: np.ndarray):
        self.sorted = np.sort(common)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(common & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, found: np.ndarray) -> np.ndarray:
        hit = self.maybe[(found & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = np.isin(found[at], self.sorted)
        return hit


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_key (id, NO_ID for null), _tag (31 bits of the text's hash) and _text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_key"),
        F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_tag"),
        text.alias("_text"),
    )


def common_seeds(keyed: DataFrame) -> np.ndarray:
    """Seeds above COMMON_SHARE of all seeds in a 64th of the documents: at most 1 / COMMON_SHARE."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = Learned(xxhash.xxh64_intdigest)
        for text in texts(batch.column(0)):
            words = text.split()
            found = seeds(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["seed"])

    sample = keyed.where(F.pmod(F.xxhash64("_key", "_tag"), F.lit(SAMPLE_OF)) == 0)
    counted = map_batches(sample.select("_text"), run, "seed long").groupBy("seed").agg(
        F.count(F.lit(1)).alias("n")).persist()
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_LEAST, total * COMMON_SHARE)
    found = [r["seed"] for r in counted.where(F.col("n") > least).select("seed").collect()]
    counted.unpersist()
    return np.array(found, np.int64).view(np.uint64)


# Packing


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


class Packer:
    """Cuts documents into packed stretches; one for each task, so it remembers what it has sent."""

    def __init__(self, buckets: int, common: np.ndarray):
        self.buckets, self.common = buckets, Common(common)
        self.known = Learned(xxhash.xxh64_intdigest)
        self.sent: dict[bytes, tuple[int, int, int]] = {}
        self.press = zstandard.ZstdCompressor(level=3)

    def __call__(self, keys: list[int], tags: list[int], contents: list[bytes]) -> Iterator[tuple]:
        """(bucket, words, places) rows; bucket -1 has no words: stretches known to be repeated."""
        split = [c.split() for c in contents]
        sizes = np.array([len(s) for s in split], np.int64)
        words = [w for s in split for w in s]
        del split
        if len(words) < WINDOW:
            return
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        joined = b" ".join(words)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        del words, lengths
        found = seeds(hashes)
        del hashes
        # common seeds sort after all others
        found = np.where(self.common(found), found | np.uint64(1 << 63), found >> np.uint64(1))
        least = sliding_min(found, WINDOW - SEED + 1)
        doc_at = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(least))
        at = at[at <= (doc_at + sizes - WINDOW)[owner[: len(least)]]]
        if not len(at):
            return
        new = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])]
        first = at[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(at)])
        who = owner[first]
        start = first - doc_at[who]
        bucket = (mixed(least[first], 2) % np.uint64(self.buckets)).astype(np.int64)
        key, tag = np.array(keys, np.int64)[who], np.array(tags, np.int32)[who]

        strings, send, again = [], [], []
        if len(self.sent) > _REMEMBERED:
            self.sent.clear()
        sent = self.sent
        for n, (a, b, place) in enumerate(zip(
            begins[first].tolist(), ends[first + count + WINDOW - 2].tolist(),
            zip(key.tolist(), start.tolist(), tag.tolist()),
        )):
            string = joined[a:b]
            before = sent.get(string)
            # another text at the same place may have the passage from elsewhere too, so it is sent
            if before is None or place[:2] < before[:2] or place[:2] == before[:2] and place != before:
                sent[string] = place
                strings.append(string)
                send.append(n)
            elif place != before:
                again.append(n)
        send, again = np.array(send, np.int64), np.array(again, np.int64)
        order = np.argsort(bucket[send], kind="stable")
        send = send[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket[send])) + 1).tolist(), len(send)]
        for a, b in zip(cuts, cuts[1:] if len(send) else []):
            rows = send[a:b]
            text = b"\n".join([strings[i] for i in order[a:b]])
            yield (int(bucket[rows[0]]), self.press.compress(text),
                   self._places(key[rows], tag[rows], start[rows], count[rows]))
        if len(again):
            yield -1, b"", self._places(key[again], tag[again], start[again], count[again])

    def _places(self, key, tag, start, count) -> bytes:
        parts = [np.diff(key, prepend=key[:1]), tag, start.astype(np.int32), count.astype(np.int32)]
        head = np.array([len(key), key[0]], np.int64).tobytes()
        return head + self.press.compress(_pack(parts))


def _unpacked(places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, first = np.frombuffer(places[:16], np.int64)
    data = zstandard.ZstdDecompressor().decompress(places[16:])
    key = first + np.cumsum(np.frombuffer(data, np.int64, n))
    tag, start, count = np.frombuffer(data, np.int32, 3 * n, 8 * n).reshape(3, n)
    return key, tag, start.astype(np.int64), count.astype(np.int64)


class _Ids(dict):
    """Consecutive numbers for distinct words."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def repeated(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """(key, tag, start, count) of the stretches of repeated windows in one bucket.

    A window is repeated if the bucket holds the same words at a smaller (key, start).
    """
    press = zstandard.ZstdDecompressor()
    key, tag, start, count = (
        np.concatenate(x) for x in zip(*(_unpacked(places) for _, places in rows)))
    number, parts = _Ids(), []
    for packed, _ in rows:
        words = press.decompress(packed).replace(b"\n", b" ").split(b" ")
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(parts)
    del number, parts, words
    hashes = rolling(mixed(ids.astype(np.uint64), 3), WINDOW)
    base = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)  # first word of each stretch
    stretch = np.repeat(np.arange(len(key), dtype=np.int32), count)
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    at = base[stretch] + inside
    hashes = hashes[at]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    met = order[np.r_[False, same] | np.r_[same, False]]  # windows with a partner
    flag = np.zeros(len(stretch), bool)
    if len(met):
        place_key, place_start = key[stretch[met]], start[stretch[met]] + inside[met]
        met = met[np.lexsort((place_start, place_key, hashes[met]))]
        place_key, place_start = key[stretch[met]], start[stretch[met]] + inside[met]
        new = np.r_[True, hashes[met][1:] != hashes[met][:-1]]
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (place_key != place_key[leader]) | (place_start != place_start[leader])
        span = np.arange(WINDOW)
        for a in range(0, len(met), 1 << 17):
            part = slice(a, a + (1 << 17))
            mine = ids[at[met[part]][:, None] + span]
            if not (mine == ids[at[met[leader[part]]][:, None] + span]).all():
                later = _by_words(ids, at[met], place_key, place_start)  # two texts, one hash
                break
        flag[met[later]] = True
    # a stretch's flags end where it ends
    begin = np.flatnonzero(flag & (np.r_[True, ~flag[:-1]] | (inside == 0)))
    end = np.flatnonzero(flag & (np.r_[~flag[1:], True] | np.r_[inside[1:] == 0, True]))
    s = stretch[begin]
    return key[s], tag[s], start[s] + inside[begin], end - begin + 1


def _by_words(ids, at, key, start) -> np.ndarray:
    """Which windows, given in order of (hash, key, start), have their words at a smaller place."""
    first: dict[bytes, tuple[int, int]] = {}
    places = list(zip(key.tolist(), start.tolist()))
    names = [ids[a:a + WINDOW].tobytes() for a in at.tolist()]
    for name, place in zip(names, places):
        first[name] = min(place, first.get(name, place))
    return np.array([place > first[name] for name, place in zip(names, places)])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_key, _tag, spans (start word, number of repeated windows) of documents with repeats."""
    bounded_batches(docs.sparkSession, max_bytes=BATCH_BYTES)
    keyed = _keyed(docs, id_col, text_col)
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, math.ceil(3 * size / BUCKET_BYTES))
    common = common_seeds(keyed)
    fields = pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("places", pa.binary())])

    def pack(batches):
        packer = Packer(buckets, common)
        keys, tags, contents, size = [], [], [], 0

        def packed():
            rows = list(packer(keys, tags, contents))
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 500]), fields)],
                    schema=fields)

        for batch in batches:
            for a, b in chunks(pc.binary_length(batch.column(2)).to_pylist(), PACK_BYTES):
                more = texts(batch.column(2).slice(a, b - a))
                keys += batch.column(0).slice(a, b - a).to_pylist()
                tags += batch.column(1).slice(a, b - a).to_pylist()
                contents += more
                size += sum(map(len, more))
                if size >= PACK_BYTES:
                    yield from packed()
                    keys, tags, contents, size = [], [], [], 0
        if contents:
            yield from packed()
        released()

    def count(batches):
        now, held = None, []
        for batch in batches:
            for bucket, words, places in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == -1 or bucket != now:
                    if held:
                        yield from spans(repeated(held))
                    now, held = bucket, []
                if bucket == -1:
                    yield from spans(_unpacked(places))
                else:
                    held.append((words, places))
        if held:
            yield from spans(repeated(held))
        held.clear()
        released()

    def spans(found) -> Iterator[pa.RecordBatch]:
        key, tag, start, count = found
        if len(key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(tag, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(count, pa.int64())],
                ["_key", "_tag", "start", "count"])

    packed = keyed.mapInArrow(pack, "bucket long, words binary, places binary")
    known = F.when(F.col("bucket") == -1, F.xxhash64("places")).otherwise(F.col("bucket"))
    dealt = packed.repartition(known).sortWithinPartitions("bucket")
    return (
        dealt.mapInArrow(count, "_key long, _tag int, start long, count long")
        .groupBy("_key", "_tag")
        .agg(F.collect_list(F.struct("start", "count")).alias("spans"))  # at most a document's words
    )


def stripped_rows(
    docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """_row (a struct of all columns of docs), n_words, n_removed, kept_sha256 and kept of every row.

    Every word covered by a window of 20 words that also starts earlier (in a document of a smaller id, or
    further ahead in the same one) is removed; windows are judged on the input. kept is
    the text itself where nothing was removed, else the kept words joined by one space (null unless
    with_text); kept_sha256 is always that of the joined words. Null text: no words, and kept is null. A null id
    comes before all others. Rows of one id count as one document: a window of one that starts further ahead removes
    words of another, one at the same start does not. Fewer than 20 words: nothing is removed. Empty table: no rows.
    """
    place = F.concat_ws(":", "_key", "_tag").alias("_at")
    spans = materialize(removals(docs, id_col, text_col).select(place, "spans"), "repeats-spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the text travels inside its row, and a second time only if it is no string there
    inside = isinstance(docs.schema[text_col].dataType, T.StringType)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_key"),
        F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_tag"),
        F.lit(None).cast("string").alias("_text") if inside else F.col(text_col).cast("string").alias("_text"),
    ).select("_row", "_text", place)
    joined = left_join(rows, spans, "_at").select("_row", "_text", "spans")

    def strip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, digests, kept = [], [], [], []
        column = batch.column(0).field(text_col) if inside else batch.column(1)
        nulls = column.is_null().to_pylist()
        all_spans = batch.column(2).to_pylist()
        for text, is_null, spans in zip(texts(column), nulls, all_spans):
            words = text.split()
            left = words
            if spans:
                gone = np.zeros(len(words), bool)
                for s in spans:
                    gone[s["start"]: s["start"] + s["count"] + WINDOW - 1] = True
                left = [w for w, g in zip(words, gone.tolist()) if not g]
            whole = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digests.append(hashlib.sha256(whole).hexdigest())
            kept.append(None if is_null or not with_text else whole if spans else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["_row", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = joined.schema["_row"].dataType.simpleString()
    return map_batches(
        joined, strip, f"_row {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row, as stripped_rows has it; other columns are ignored."""
    narrow = docs.select(*dict.fromkeys([id_col, text_col]))
    return stripped_rows(narrow, False, id_col, text_col).select(
        F.col("_row").getField(id_col).alias(id_col), "n_words", "n_removed", "kept_sha256")


#: The same in DuckDB, over every window of every document.
REPEATS_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (
    SELECT doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') AS seq
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM d)),
again AS (
    SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM again, (SELECT unnest(range(20)) AS k)),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d)
    ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
