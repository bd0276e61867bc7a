"""SimHash fingerprints and near-duplicate links by the generalised pigeonhole principle.

Fingerprints within `max_bits` differing bits are found without comparing all pairs. The 64 bits are
cut into parts; if each part i has a threshold T_i and the T_i add up to max_bits - parts + 1, two
fingerprints within max_bits must differ in at most T_i bits in some part i. So a fingerprint is
indexed under the value of each part, probes the values within T_i flips of its own, and whatever
it meets is verified on all 64 bits.

Three choices depend on the data and change cost only, never a link. Bits that are set together are
grouped into one part, so the other parts stay selective. The number of parts follows from the
number of fingerprints. The thresholds are unequal: dynamic programming gives the flips to the parts where they
are estimated to bring the fewest candidates.

Exact copies are one class before any of this. Buckets above BLOCK fingerprints are cut into blocks, and every
pair of blocks is a bucket of its own; a bucket sends back at most a spanning set of its links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.skew import is_small, left_join
from storelens.llm.common import chunks, map_batches, texts
from storelens.session import materialize

BITS = 64
BLOCK = 4096
SMALL_RUN = 16
# Seconds for a key that is written and sorted, and for one comparison: only their ratio matters.
KEY_COST, PAIR_COST = 4e-6, 5e-9
NO_ID = -(2**63)  # stands for a null id, before all others


# Fingerprints


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; fewer words are one run."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    n = len(found)
    joined = b" ".join(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts)
    )


def mixed(h: np.ndarray, round_: int) -> np.ndarray:
    """Another 64 bits from each hash; round 0 is the hash itself."""
    if round_ == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(round_)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def majority_bits(hashes: list[np.ndarray], round_: int = 0, rows: int = 65_536) -> np.ndarray:
    """For each array of hashes the bits that over half of them have set."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), BITS), np.int64)
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for at in range(0, len(flat), rows):
        part = mixed(flat[at:at + rows], round_)
        who = owner[at:at + rows]
        bits = np.unpackbits(
            part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    is_set = 2 * counts > sizes[:, None]
    return np.packbits(is_set, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(
    docs: DataFrame, words: int = 3, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and fingerprint (fingerprint, fingerprint1, ... for several rounds) of every row."""
    names = ["fingerprint", *(f"fingerprint{r}" for r in range(1, rounds))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1)
        sizes = [len(t) if t else 0 for t in column.to_pylist()]
        for a, b in chunks(sizes):
            hashes = [shingle_hashes(t.lower(), words) for t in texts(column.slice(a, b - a))]
            found = [pa.array(majority_bits(hashes, r).view(np.int64)) for r in range(rounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *found], ["doc_id", *names]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names),
    )


# The plan: parts and thresholds


def probes(width: int, threshold: int) -> int:
    """How many values lie within `threshold` flips of a part."""
    return sum(math.comb(width, t) for t in range(threshold + 1))


def part_count(n: int, max_bits: int) -> int:
    """The cheapest number of parts for n fingerprints with even bits."""

    def cost(parts: int) -> float:
        spare, rest = divmod(max_bits - parts + 1, parts)
        total = 0.0
        for i in range(parts):
            width = BITS // parts + (i < BITS % parts)
            keys = probes(width, spare + (i < rest))
            total += n * keys * KEY_COST + n * n / 2 * keys / 2**width * PAIR_COST
        return total

    return min(range(1, max_bits + 2), key=cost)


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups, correlated ones together. together[i, j]: rows with both bits set."""
    mean = np.diag(together) / n
    cov = together / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    free = list(range(BITS))
    out = []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        group = [max(free, key=lambda b: corr[b, free].max())]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def thresholds(n: int, max_bits: int, widths: list[int], collide: list[float]) -> list[int]:
    """The cheapest thresholds whose sum is max_bits - parts + 1; -1 leaves a part out.

    collide[i] is the share of pairs that agree in part i; a part's candidates at threshold t
    are estimated as that share times the number of values probed.
    """

    def cost(i: int, t: int) -> float:
        keys = probes(widths[i], t)
        pairs = n * n / 2 * min(1.0, collide[i] * keys)
        return n * keys * KEY_COST + pairs * PAIR_COST

    goal = max_bits - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, width in enumerate(widths):
        after: dict[int, tuple[float, list[int]]] = {}
        for (spent, (so_far, chosen)), t in itertools.product(
            best.items(), range(-1, min(width, max_bits) + 1)
        ):
            total = so_far + cost(i, t)
            if total < after.get(spent + t, (math.inf, []))[0]:
                after[spent + t] = (total, [*chosen, t])
        best = after
    return best[goal][1]


def part_values(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits):
        value |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return value


def bucket_key(part: int, value: np.ndarray) -> np.ndarray:
    """One number for (part, value); a collision would only merge two buckets."""
    return mixed(value, part + 1).view(np.int64)


def plan(prints: DataFrame, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, from statistics over all fingerprints."""

    def both_set(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.unpackbits(
            values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).astype(np.float32)
        gram = (bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(gram.reshape(-1))], ["at", "n"])

    summed = map_batches(prints, both_set, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    gram = np.zeros(BITS * BITS)
    for row in summed.collect():  # 64 x 64 sums
        gram[row["at"]] = row["n"]
    groups = grouped_bits(gram.reshape(BITS, BITS), n, part_count(n, max_bits))

    def values(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i, bits in enumerate(groups):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), i, np.int32)),
                 pa.array(part_values(found, bits).view(np.int64))], ["part", "value"])

    per_part = (
        map_batches(prints, values, "part int, value long")
        .groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("part").agg(F.sum(F.col("n").cast("double") ** 2).alias("squares"))
    )
    share = {r["part"]: r["squares"] / n / n for r in per_part.collect()}  # one row a part
    widths = [len(g) for g in groups]
    chosen = thresholds(n, max_bits, widths, [share[i] for i in range(len(groups))])
    return list(zip(groups, chosen))


# Probe and verify


def keyed(prints: DataFrame, parts: list[tuple[list[int], int]], carried: str = "") -> DataFrame:
    """key, probe (0 indexed, 1 probing) and the columns of prints, for every part and flip."""
    flips = [
        [sum(1 << b for b in c) for t in range(1, limit + 1)
         for c in itertools.combinations(range(len(bits)), t)]
        for bits, limit in parts
    ]
    names = prints.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i, (bits, limit) in enumerate(parts):
            if limit < 0:
                continue
            value = part_values(found, bits)
            for probe, flip in [(0, 0), *((1, f) for f in flips[i])]:
                key = bucket_key(i, value ^ np.uint64(flip))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.full(len(key), probe, np.int8)), *batch.columns],
                    ["key", "probe", *names])

    return map_batches(prints, run, f"key long, probe byte, fingerprint long{carried}")


def in_blocks(rows: DataFrame, member: str = "fingerprint", most: int = BLOCK) -> DataFrame:
    """rows with `bucket`: the key, or for keys above `most` rows one bucket for each pair of blocks.

    `member` is what the blocks are dealt by: any two members of a key meet in some bucket.
    """
    large = materialize(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
        .select("key", F.ceil(F.col("rows") / most).cast("int").alias("blocks")), "simhash-large",
    )
    if large.isEmpty():
        return rows.withColumn("bucket", F.col("key")).drop("key")
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1)))
                      .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (
        rows.join(large, "key", "left").withColumn("own", own).withColumn("other", other)
        .withColumn("bucket", F.when(F.col("other") < 0, F.col("key")).otherwise(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))))
        .drop("key", "blocks", "own", "other")
    )


def spanning(prints: np.ndarray, probe: np.ndarray, within) -> np.ndarray:
    """For each row of one bucket the smallest row it is linked with, over any number of links."""
    n = len(prints)
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        i, j = np.nonzero(within(slice(a, a + step), slice(0, n)))
        i += a
        keep = (i != j) & (probe[i] + probe[j] < 2)
        i, j = i[keep], j[keep]
        while len(i):
            while (label != label[label]).any():
                label = label[label]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            apart = low != high
            i, j = i[apart], j[apart]
            np.minimum.at(label, high[apart], low[apart])  # only roots move; links left over come again
    while (label != label[label]).any():
        label = label[label]
    return label


def bucket_links(
    bucket: np.ndarray, probe: np.ndarray, prints: list[np.ndarray], limits: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (i, j) of sorted whole buckets: all links of small ones, a spanning set of others.

    Rows link when, for each k, the first k + 1 fingerprints together differ in at most limits[k] bits.
    """
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[first, len(bucket)])
    size_of = np.repeat(sizes, sizes)

    def close(i, j) -> np.ndarray:
        far, ok = 0, True
        for p, limit in zip(prints, limits):
            far = far + np.bitwise_count(p[i] ^ p[j]).astype(np.int16)
            ok = ok & (far <= limit)
        return ok

    left, right = [], []
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_RUN))
    for d in range(1, SMALL_RUN):
        i = small[small + d < len(bucket)]
        i = i[bucket[i] == bucket[i + d]]
        if not len(i):
            break
        i = i[(probe[i] + probe[i + d]) < 2]
        i = i[close(i, i + d)]
        left.append(i)
        right.append(i + d)
    for a, n in zip(first[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
        label = spanning(
            prints[0][a:a + n], probe[a:a + n],
            lambda i, j, a=a, n=n: close(
                np.arange(a, a + n)[i][:, None], np.arange(a, a + n)[j][None, :]),
        )
        moved = np.flatnonzero(label != np.arange(n))
        left.append(a + label[moved])
        right.append(a + moved)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(rows: DataFrame, limits: list[int]) -> DataFrame:
    """Distinct linked node pairs of rows (bucket, probe, fingerprint, [fingerprint1, ...,] node)."""
    rounds = len(limits)

    def run(batches):
        def solve(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, probe, *prints = columns
            node = prints[rounds] if len(prints) > rounds else prints[0]
            i, j = bucket_links(bucket, probe, [p.view(np.uint64) for p in prints[:rounds]], limits)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            keep = a != b
            if keep.any():
                pairs = np.unique(np.stack([a[keep], b[keep]]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = np.searchsorted(now[0], now[0][-1])  # the last bucket may go on in the next batch
            if last:
                done = [np.concatenate(c) for c in zip(*held, [c[:last] for c in now])]
                yield from solve(done)
                held = [[c[last:] for c in now]]
            elif held and held[0][0][0] != now[0][0]:
                yield from solve([np.concatenate(c) for c in zip(*held)])
                held = [now]
            else:
                held.append(now)
        if held:
            yield from solve([np.concatenate(c) for c in zip(*held)])

    names = ["bucket", "probe", *(c for c in rows.columns if c not in ("bucket", "probe"))]
    return (
        rows.select(names).repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(run, "a long, b long").distinct()
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and root (its component's smallest node) of every node on an edge (a, b).

    Large-star and small-star rounds until nothing changes. Minima are pre-aggregated, and the join that
    spreads them is one Spark can split, so a node with very many neighbours is no bottleneck.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        near = both if large else both.where("v < u")
        low = near.groupBy("u").agg(F.min("v").alias("low"))
        low = low.withColumn("low", F.least("u", "low"))
        joined = near.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("low").alias("a"), F.col("v").alias("b")).union(
                low.select(F.col("low").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    def state(edges: DataFrame):
        return edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()

    now = materialize(edges.where("a < b").select("a", "b").distinct(), label)
    before = state(now)
    while True:
        now = materialize(star(star(now, True), False), label)
        after = state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(now.select("a", "a").distinct().toDF("node", "root"))


def near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of docs.

    component_id is the smallest id reachable over links of at most max_bits differing bits, a
    document's own included. All links count: none is capped or sampled. Null and empty
    texts have fingerprint 0 and link like any other. Rows with a null id take part; a component of
    nothing but null ids has a null component_id. Repeated rows stay. Empty table: no rows.
    Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, 1, id_col, text_col), "simhash-prints")
    classes = materialize(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-classes"
    )
    n = classes.count()
    if n > 1:
        alone = classes.select("fingerprint")
        rows = in_blocks(keyed(alone, plan(alone, n, max_bits)))
        roots = materialize(components(links(rows, [max_bits]), "simhash-stars"), "simhash-roots")
        linked = classes.join(roots, classes["fingerprint"] == roots["node"]).select(
            "fingerprint", "first", "root")
        smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
        moved = linked.join(smallest, "root").select("fingerprint", "component")
        classes = classes.join(moved, "fingerprint", "left")
    else:
        classes = classes.withColumn("component", F.col("first"))
    classes = classes.select("fingerprint", F.coalesce("component", "first").alias("component_id"))
    return left_join(prints, classes, "fingerprint", "inner").select(
        F.col("doc_id").alias(id_col), "fingerprint", "component_id"
    )


def without_copies(
    docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component of `near_duplicates`.

    One row of each component stays: of the smallest id (null before all others), of rows equal in id
    the one whose text has the smallest hash, and one of rows equal in id and text. Null and empty texts, and
    texts without words, are copies of each other. Very long texts count whole. Empty table: no rows.
    Other columns stay as they are, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    at = F.struct(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("hash"))
    grouped = materialize(
        near_duplicates(docs.select(at.alias("at"), text.alias("text")), words, max_bits, "at", "text"),
        "simhash-groups")
    out = grouped.where("at != component_id").select(F.col("at").alias("_at")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), at.alias("_at"))
    kept = rows.join(F.broadcast(out) if is_small(out) else out, "_at", "left_anti")
    if not grouped.groupBy("at").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_at"])
    return kept.select("_row.*")
