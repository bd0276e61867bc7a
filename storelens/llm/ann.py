"""Exact nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are cut into blocks of bounded size, and every pair of blocks is a tile. A
vector x is stored as a scale s and int8 q with x = s q + r; its error |r| is known. So the product of two
int8 blocks gives all distances of a tile up to the sum of two known errors. Per query, the k-th smallest
upper bound in the tile rules out every candidate whose lower bound is above it; what survives is
recomputed from the original vectors in double precision. Nothing that belongs to the
k nearest can be lost, so the result is exact: recall is 1.

Each tile sends k rows a query on, and heaps merge them in rounds of MERGE tiles, so neither a
tile nor a merge grows with the data. The product is taken in float32, where sums of int8 products
are exact up to 1040 dimensions, beyond that in float64.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, BASE_BLOCK, ROWS_AT_ONCE, MERGE = 2048, 8192, 256, 64
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the lengths of what they leave out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def tile(
    query_ids: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, distance) of each query's k nearest in the tile, by distance and id.

    Rows of one vec_id are one candidate, at its smallest distance.
    """
    qq, qs, qe = quantised(queries)
    cq, cs, ce = quantised(base)
    kind = np.float32 if queries.shape[1] <= 1040 else np.float64
    turned = cq.T.astype(kind)
    q_norm = (qq.astype(np.int64) ** 2).sum(axis=1) * qs**2
    c_norm = (cq.astype(np.int64) ** 2).sum(axis=1) * cs**2
    most = k + len(base_ids) - len(np.unique(base_ids))  # repeated ids may fill the first places
    out = []
    for a in range(0, len(query_ids), ROWS_AT_ONCE):
        at = slice(a, a + ROWS_AT_ONCE)
        product = (qq[at].astype(kind) @ turned).astype(np.float64)
        square = q_norm[at, None] + c_norm[None, :] - 2 * qs[at, None] * cs[None, :] * product
        # rounding in `square` is far below this part of its terms
        blur = 1e-12 * (q_norm[at, None] + c_norm[None, :])
        error = qe[at, None] + ce[None, :]
        low = np.sqrt(np.maximum(square - blur, 0)) - error * (1 + 1e-9)
        high = np.sqrt(np.maximum(square, 0) + blur) + error * (1 + 1e-9)
        own = query_ids[at, None] == base_ids[None, :]
        high[own] = np.inf
        if high.shape[1] > most:
            bound = np.partition(high, most - 1, axis=1)[:, most - 1]
        else:
            bound = np.full(len(high), np.inf)
        i, j = np.nonzero((low <= bound[:, None]) & ~own)
        for b in range(0, len(i), 1 << 20):
            ii, jj = i[b:b + (1 << 20)], j[b:b + (1 << 20)]
            out.append((a + ii, base_ids[jj], exact(queries[a + ii], base[jj])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, vec, score = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((score, vec, row))  # repeated ids: the nearest first
    row, vec, score = row[order], vec[order], score[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (vec[1:] != vec[:-1])]
    row, vec, score = row[new], vec[new], score[new]
    order = np.lexsort((vec, score, row))
    row, vec, score = row[order], vec[order], score[order]
    first = np.searchsorted(row, row, side="left")
    near = np.arange(len(row)) - first < k
    return query_ids[row[near]], vec[near], score[near]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks()
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)


def nearest(
    base: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of base for each of its rows with is_query.

    Smallest Euclidean distance first, ties to the smaller id, the query's own id left out;
    all candidates if there are fewer than k. Vectors null, empty, zero or with null or non-finite components
    and rows without an id take no part. Vectors of another length than the query's are no candidates.
    Rows of one id are one candidate, at its smallest distance. Empty table: no rows. Other columns are ignored.
    """
    vectors = (
        base.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("bigint").alias("vec_id"), F.size(vector_col).alias("dim"),
                F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    )
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    tiles = max(1, math.ceil(counts["n"] / BASE_BLOCK))
    asked = max(1, math.ceil((counts["q"] or 0) / QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    columns = ["dim", "asked", "tile", "vec_id", "vector", "asks"]
    asking = (
        vectors.where("asks").withColumn("asked", block(asked).cast("int"))
        .withColumn("tile", every(tiles)).select(columns)
    )
    answering = (
        vectors.withColumn("asks", F.lit(False)).withColumn("tile", block(tiles).cast("int"))
        .withColumn("asked", every(asked)).select(columns)
    )
    fields = _FOUND.append(pa.field("tile", pa.int32()))

    def one_tile(key, rows):
        asks = rows.column("asks")
        left, right = rows.filter(asks), rows.filter(pc.invert(asks))
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        query_id, vec_id, score = tile(*_matrix(left), *_matrix(right), k)
        number = np.full(len(vec_id), key[2].as_py(), np.int32)
        return pa.table([query_id, vec_id, score, number], schema=fields)

    found = asking.unionByName(answering).groupBy("dim", "asked", "tile").applyInArrow(
        one_tile, "query_id long, vec_id long, score double, tile int"
    )

    def merge(key, rows):
        heap: dict[int, float] = {}
        for vec, score in zip(rows.column("vec_id").to_pylist(), rows.column("score").to_pylist()):
            if score < heap.get(vec, math.inf):
                heap[vec] = score
        best = heapq.nsmallest(k, ((s, v) for v, s in heap.items()))
        return pa.table(
            [[key[0].as_py()] * len(best), [v for _, v in best], [s for s, _ in best],
             list(range(1, len(best) + 1)), [key[1].as_py()] * len(best)],
            schema=pa.schema([*_FOUND, ("rank", pa.int32()), ("tile", pa.int32())]),
        )

    while True:
        found = found.withColumn("tile", F.expr(f"cast(tile div {MERGE} as int)"))
        found = found.groupBy("query_id", "tile").applyInArrow(
            merge, "query_id long, vec_id long, score double, rank int, tile int")
        tiles = math.ceil(tiles / MERGE)
        if tiles == 1:
            break
    return found.select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB, over all pairs. list_distance adds in an order of its own, so the
#: distances of each query's first 20 are added up again in the order of the components.
NEAREST_SQL = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.e AS a, c.e AS b, list_distance(q.e, c.e) AS d
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
first AS (
    SELECT query_id, vec_id, sqrt(list_reduce(
        list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])),
        lambda x, y: x + y)) AS score
    FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 20)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM first QUALIFY rank <= 10
"""
