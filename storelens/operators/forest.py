"""Random forests on binned rows, as Spark's own models.

Features are cut at no more than 31 places once, so that a row is one byte a feature. While a node holds more than LOCAL rows, its
level is grown by one aggregate of (node, feature, bin, label) counts over all rows. Rows of a smaller node are sent to
one task, once, and all levels below are grown there: a level of many small nodes costs no pass over the input and no counts
for cells that are empty. Trees are taken in batches, so that what is sent at a time is bounded.

A row's weight in a tree is a Poisson draw by seed, tree, block and place in the block; a node's features are drawn by seed,
tree and node. So a task that is run again gives the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import RDD, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import materialize, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

BINS = 32
EDGE_ROWS = 10_000  # rows whose values say where features are cut, as Spark takes them
LOCAL = 1_000_000  # rows, as often as drawn, of a node that one task grows: a byte for each feature, and some arrays
BATCH_BYTES = 512 * 1024**2  # of rows sent to the tasks of one batch of trees
NODES_AT_ONCE = 2048
LEAST_GAIN = 1e-12

Tree = dict[str, np.ndarray]
_COLUMNS = {"feature": "i4", "bin": "i4", "left": "i4", "depth": "i4", "n0": "f8", "n1": "f8", "gain": "f8"}


def cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where to cut a feature: between all its values if they are few, else at even steps of their counts."""
    value, count = np.unique(values, return_counts=True)
    between = (value[:-1] + value[1:]) / 2
    if len(between) < bins:
        return between
    stride, upto, found = len(values) / bins, np.cumsum(count), []
    target = stride
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found[: bins - 1])


def _edges(train: DataFrame, features: tuple[str, ...], rows: int, seed: int) -> list[np.ndarray]:
    some = train.select(*[F.col(f).cast("double") for f in features])
    if rows > EDGE_ROWS:
        some = some.sample(EDGE_ROWS / rows, seed)
    values = np.array([tuple(r) for r in some.collect()], dtype=float)
    return [cuts(values[:, i]) for i in range(len(features))]


def _blocks(train: DataFrame, features: tuple[str, ...], label: str, edges: list[np.ndarray]) -> DataFrame:
    """block, n, label and bins (one byte each, rows together) of some rows; written, so that places in it stay."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, len(edges)), np.uint8)
            for i, edge in enumerate(edges):
                value = batch.column(i).to_numpy(zero_copy_only=False)
                if np.isnan(value).any():
                    raise ValueError(f"feature {features[i]} has missing values")
                x[:, i] = np.searchsorted(edge, value)
            y = batch.column(len(edges)).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "labels": [y.tobytes()], "bins": [x.tobytes()]})

    rows = train.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("int"))
    packed = rows.mapInArrow(pack, "n int, labels binary, bins binary").where("n > 0")
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), "forest-rows")


def _draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree takes each row of a block."""
    return np.random.Generator(np.random.PCG64([seed, tree, block])).poisson(1.0, n).astype(np.uint8)


def _subset(seed: int, tree: int, node: int, level: int, nodes: int, features: int, size: int) -> np.ndarray:
    """The features that each node of a level may be cut by."""
    if size >= features:
        return np.tile(np.arange(features), (nodes, 1))
    draws = np.random.Generator(np.random.PCG64([seed, tree, node, level])).random((nodes, features))
    return np.argpartition(draws, size - 1, axis=1)[:, :size]


def _counts(at: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Rows by node, feature of its subset, bin and label."""
    nodes, size = subset.shape
    cell = np.take_along_axis(x, subset[at], axis=1).astype(np.int64)
    cell += (at[:, None] * size + np.arange(size)) * BINS
    cell = cell * 2 + y[:, None]
    found = np.bincount(cell.ravel(), np.repeat(n, size), nodes * size * BINS * 2)
    return found.reshape(nodes, size, BINS, 2)


def best(counts: np.ndarray, subset: np.ndarray, weights: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Per node the cut of most gain in weighted Gini impurity that leaves `least` rows on either side; gain 0 if none."""
    left = np.cumsum(counts, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    a, b, c = left * weights, right * weights, total * weights

    def purity(v: np.ndarray) -> np.ndarray:
        whole = v.sum(-1)
        return (v**2).sum(-1) / np.where(whole > 0, whole, 1.0)

    whole = np.maximum(c.sum(-1), 1e-300)
    gain = (purity(a) + purity(b) - purity(c)) / whole
    allowed = (left.sum(-1) >= least) & (right.sum(-1) >= least)
    gain = np.where(allowed, gain, 0.0).reshape(len(counts), -1)
    pick = gain.argmax(axis=1)
    node = np.arange(len(counts))
    slot, at = pick // (BINS - 1), pick % (BINS - 1)
    return {
        "gain": gain[node, pick], "feature": subset[node, slot], "bin": at,
        "left": left[node, slot, at], "total": total[node, slot, 0],
    }


def grow(
    x: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray, depth: int, least: int, size: int,
    seed: tuple[int, int, int] = (0, 0, 0), start: int = 0,
) -> Tree:
    """The tree over rows that fit into a task, a level at a time, its nodes in the order of their levels."""
    made: dict[str, list[np.ndarray]] = {c: [] for c in _COLUMNS}
    sums = np.bincount(y, n, 2).reshape(1, 2)
    at, first, level = np.zeros(len(y), np.int64), 0, start
    while len(sums):
        nodes = len(sums)
        cut = {"feature": np.full(nodes, -1), "bin": np.full(nodes, -1), "left": np.full(nodes, -1),
               "depth": np.full(nodes, level), "n0": sums[:, 0], "n1": sums[:, 1], "gain": np.zeros(nodes)}
        split_sums = np.zeros((nodes, 2, 2))
        if level < depth:
            mixed = (sums.min(axis=1) > 0) & (sums.sum(axis=1) >= 2 * least)
            keep = mixed[at]
            narrow = np.uint16 if nodes <= 2**16 else np.int64  # sorted by digits
            order = np.flatnonzero(keep)[np.argsort(at[keep].astype(narrow), kind="stable")]
            at, x, y, n = at[order], x[order], y[order], n[order]
            subset = _subset(*seed, level, nodes, x.shape[1], size)
            for a in range(0, nodes, NODES_AT_ONCE):
                z = min(a + NODES_AT_ONCE, nodes)
                r = slice(*np.searchsorted(at, [a, z]))
                if r.start == r.stop:
                    continue
                found = best(_counts(at[r] - a, x[r], y[r], n[r], subset[a:z]), subset[a:z], weights, least)
                yes = np.flatnonzero(found["gain"] > LEAST_GAIN)
                for c in ("feature", "bin", "gain"):
                    cut[c][a + yes] = found[c][yes]
                split_sums[a + yes, 0] = found["left"][yes]
                split_sums[a + yes, 1] = (found["total"] - found["left"])[yes]
        split = np.flatnonzero(cut["feature"] >= 0)
        cut["left"][split] = first + nodes + 2 * np.arange(len(split))
        for c, kind in _COLUMNS.items():
            made[c].append(np.asarray(cut[c], kind))
        keep = cut["feature"][at] >= 0
        at, x, y, n = at[keep], x[keep], y[keep], n[keep]
        rank = np.zeros(nodes, np.int64)
        rank[split] = np.arange(len(split))
        right = x[np.arange(len(at)), cut["feature"][at]] > cut["bin"][at]
        at = 2 * rank[at] + right
        sums = split_sums[split].reshape(-1, 2)
        first, level = first + nodes, level + 1
    return {c: np.concatenate(parts) for c, parts in made.items()}


def _place(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The last node of each row."""
    at, row = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(row):
        row = row[tree["left"][at[row]] >= 0]
        here = at[row]
        at[row] = tree["left"][here] + (x[row, tree["feature"][here]] > tree["bin"][here])
    return at


def _graft(top: Tree, below: dict[int, Tree]) -> Tree:
    """The whole tree; children come after their node."""
    parts = {c: [top[c].copy()] for c in _COLUMNS}
    many = len(top["left"])
    for node, tree in below.items():
        left = np.where(tree["left"] >= 0, tree["left"] + many - 1, -1)
        for c in _COLUMNS:
            values = left if c == "left" else tree[c]
            parts[c][0][node] = values[0]
            parts[c].append(values[1:])
        many += len(left) - 1
    return {c: np.concatenate(p) for c, p in parts.items()}


def prune(tree: Tree, weights: np.ndarray) -> Tree:
    """Two leaves of one prediction become one, as Spark has it; the nodes that stay, numbered without gaps."""
    left, depth = tree["left"].copy(), tree["depth"]
    ones = tree["n1"] * weights[1] > tree["n0"] * weights[0]
    for level in range(depth.max() - 1, -1, -1):
        inner = np.flatnonzero((depth == level) & (left >= 0))
        a = left[inner]
        left[inner[(left[a] < 0) & (left[a + 1] < 0) & (ones[a] == ones[a + 1])]] = -1
    keep = np.zeros(len(left), bool)
    keep[0] = True
    for level in range(depth.max()):
        inner = np.flatnonzero((depth == level) & (left >= 0) & keep)
        keep[left[inner]] = keep[left[inner] + 1] = True
    number = np.cumsum(keep) - 1
    out = {c: v[keep] for c, v in tree.items()}
    inner = out["left"] = left[keep]
    out["left"] = np.where(inner >= 0, number[inner], -1)
    return out


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of bins as bytes: three bins of 5 bits in two bytes."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 3))).astype("<u2")
    return np.ascontiguousarray(x[:, 0::3] | x[:, 1::3] << 5 | x[:, 2::3] << 10).view(np.uint8)


def unpacked(rows: np.ndarray, features: int) -> np.ndarray:
    """The bins of packed rows."""
    three = np.ascontiguousarray(rows).view("<u2")
    x = np.stack([three >> shift & (BINS - 1) for shift in (0, 5, 10)], axis=2).astype(np.uint8)
    return x.reshape(len(rows), 3 * three.shape[1])[:, :features]


def _read(row) -> tuple[int, np.ndarray, np.ndarray]:
    return row["block"], np.frombuffer(row["bins"], np.uint8).reshape(row["n"], -1), np.frombuffer(row["labels"], np.uint8)


def _large_nodes(
    blocks: RDD, tops: dict[int, Tree], weights: np.ndarray, depth: int, least: int, features: int, size: int, seed: int
) -> None:
    """Grows the trees, level by level, until no node that can be cut holds more than LOCAL rows."""
    for level in range(depth):
        open_nodes = {}
        for t, top in tops.items():
            large = np.flatnonzero((top["depth"] == level) & (top["n0"] + top["n1"] > LOCAL)
                                   & (np.minimum(top["n0"], top["n1"]) > 0))
            if len(large):
                open_nodes[t] = large, _subset(seed, t, 0, level, len(large), features, size)
        if not open_nodes:
            return
        level_tops = {t: tops[t] for t in open_nodes}

        def count(rows: Iterator) -> Iterator:
            sums: dict[int, np.ndarray] = {}
            for row in rows:
                block, x, y = _read(row)
                for t, (nodes, subset) in open_nodes.items():
                    n = _draws(seed, t, block, len(y))
                    place = np.full(len(level_tops[t]["left"]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[_place(level_tops[t], x)]
                    has = np.flatnonzero((at >= 0) & (n > 0))
                    found = _counts(at[has], x[has], y[has], n[has], subset)
                    sums[t] = sums[t] + found if t in sums else found
            yield from sums.items()

        parts = min(len(open_nodes), 2 * blocks.context.defaultParallelism)
        found = blocks.mapPartitions(count).reduceByKey(np.add, parts).map(
            lambda kv: (kv[0], best(kv[1], open_nodes[kv[0]][1], weights, least))).collect()  # a few rows a tree
        for t, cut in found:
            _cut_large(tops[t], open_nodes[t][0], cut, level)


def _cut_large(top: Tree, nodes: np.ndarray, cut: dict[str, np.ndarray], level: int) -> None:
    top["n0"][nodes], top["n1"][nodes] = cut["total"][:, 0], cut["total"][:, 1]
    yes = np.flatnonzero(cut["gain"] > LEAST_GAIN)
    split = nodes[yes]
    for c in ("feature", "bin", "gain"):
        top[c][split] = cut[c][yes]
    top["left"][split] = len(top["left"]) + 2 * np.arange(len(split))
    sums = np.stack([cut["left"][yes], (cut["total"] - cut["left"])[yes]], axis=1).reshape(-1, 2)
    new = {"feature": -1, "bin": -1, "left": -1, "depth": level + 1, "n0": sums[:, 0], "n1": sums[:, 1], "gain": 0}
    for c, kind in _COLUMNS.items():
        top[c] = np.concatenate([top[c], np.broadcast_to(new[c], len(sums)).astype(kind)])


def _whole_trees(
    blocks: RDD, tops: dict[int, Tree], weights: np.ndarray, depth: int, least: int, features: int, size: int, seed: int
) -> RDD:
    """(tree, its nodes), the rows of each small node sent to the task that grows it."""
    todo = [(t, int(node)) for t, top in tops.items() for node in np.flatnonzero(
        (top["left"] < 0) & (top["depth"] < depth) & (top["n0"] + top["n1"] <= LOCAL))]
    number = {key: i for i, key in enumerate(todo)}

    def send(row) -> Iterator:
        block, x, y = _read(row)
        for t, top in tops.items():
            n = _draws(seed, t, block, len(y))
            at = _place(top, x)
            for node in np.unique(at):
                if (t, int(node)) in number:
                    r = np.flatnonzero((at == node) & (n > 0))
                    yield number[t, int(node)], (block, np.column_stack([packed(x[r]), n[r] * 2 + y[r]]).tobytes())

    def below(item) -> tuple:
        (t, node), parts = todo[item[0]], sorted(item[1])  # by block, so that sums come in one order
        rows = np.frombuffer(b"".join(p for _, p in parts), np.uint8).reshape(-1, 1 + 2 * -(-features // 3))
        x, y, n = unpacked(rows[:, :-1], features), rows[:, -1] & 1, rows[:, -1] >> 1
        level = int(tops[t]["depth"][node])
        return t, (node, grow(x, y, n, weights, depth, least, size, (seed, t, node + 1), level))

    sent = blocks.flatMap(send).groupByKey(max(len(todo), 1), lambda i: i)
    grown = sent.map(below).groupByKey(len(tops)).mapValues(dict)
    alone = {t for t in tops} - {t for t, _ in todo}  # trees that end above
    if alone:
        grown = grown.union(blocks.context.parallelize([(t, {}) for t in alone], len(alone)))
    return grown.map(lambda kv: (kv[0], prune(_graft(tops[kv[0]], kv[1]), weights)))


def _stored_nodes(trees: RDD, weights: np.ndarray, edges: list[np.ndarray]) -> DataFrame:
    """The nodes as Spark stores them."""
    spark = SparkSession.active()

    def columns(item) -> tuple:
        t, tree = item
        a, b = tree["n0"] * weights[0], tree["n1"] * weights[1]
        inner = tree["left"] >= 0
        cut = [float(edges[f][i]) if is_inner else 0.0 for f, i, is_inner in zip(tree["feature"], tree["bin"], inner)]
        whole = np.maximum(a + b, 1e-300)
        return (int(t), (b > a).astype(float).tolist(), (1 - (a**2 + b**2) / whole**2).tolist(), a.tolist(), b.tolist(),
                (tree["n0"] + tree["n1"]).astype(int).tolist(), np.where(inner, tree["gain"], -1.0).tolist(),
                tree["left"].tolist(), np.where(inner, tree["feature"], -1).tolist(), cut)

    schema = ("treeID int, prediction array<double>, impurity array<double>, a array<double>, b array<double>, "
              "n array<bigint>, gain array<double>, left array<int>, feature array<int>, cut array<double>")
    whole = spark.createDataFrame(trees.map(columns), schema, verifySchema=False)
    names = whole.columns[1:]
    each = whole.select("treeID", F.posexplode(F.arrays_zip(*names)).alias("id", "node"))
    return each.selectExpr("treeID", """named_struct(
        'id', id, 'prediction', node.prediction, 'impurity', node.impurity, 'impurityStats', array(node.a, node.b),
        'rawCount', node.n, 'gain', node.gain, 'leftChild', node.left,
        'rightChild', if(node.left < 0, -1, node.left + 1),
        'split', named_struct('featureIndex', node.feature,
            'leftCategoriesOrThreshold', if(node.left < 0, cast(array() as array<double>), array(node.cut)),
            'numCategories', -1)) AS nodeData""")


def fit(
    train: DataFrame, features: tuple[str, ...], label: str, weights: tuple[float, float], trees: int, depth: int,
    least: int, seed: int,
) -> PipelineModel:
    """A forest for a 0/1 label whose rows weigh by their label, with sqrt(features) to choose from at a node.

    The trees go to Spark's model as it is stored: its settings are those of a forest of single nodes on two rows.
    """
    spark = train.sparkSession
    weight = np.array(weights)
    rows, size = train.count(), int(np.ceil(len(features) ** 0.5))
    if not rows:
        raise ValueError("a forest needs rows to learn from")
    edges = _edges(train, features, rows, seed)
    stored = _blocks(train, features, label, edges)
    blocks = stored.rdd
    path = scratch(spark, "forest")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    shape = spark.createDataFrame([(0, 1.0, *[0.0] * len(features)), (1, 1.0, *[1.0] * len(features))],
                                  f"`{label}` int, weight double, " + ", ".join(f"`{f}` double" for f in features))
    plain = RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, maxDepth=0, minInstancesPerNode=least,
        featureSubsetStrategy="sqrt", seed=seed).fit(assembler.transform(shape))
    plain.set(plain.maxDepth, depth)
    plain.save(path)
    sent = rows * (1 + 2 * -(-len(features) // 3))  # by a tree, at most: a third of the rows is not drawn
    batch = max(1, min(trees, BATCH_BYTES // max(1, sent)))
    mode = "overwrite"
    for some in range(0, trees, batch):
        tops = {t: _root(rows) for t in range(some, min(some + batch, trees))}
        _large_nodes(blocks, tops, weight, depth, least, len(features), size, seed)
        grown = _whole_trees(blocks, tops, weight, depth, least, len(features), size, seed)
        _stored_nodes(grown, weight, edges).write.mode(mode).parquet(f"{path}/data")
        mode = "append"
        grown._jrdd.rdd().cleanShuffleDependencies(True)  # else its files stay until the driver collects its garbage
    return PipelineModel(stages=[assembler, RandomForestClassificationModel.load(path)])


def _root(rows: int) -> Tree:
    """A tree before its first cut; its counts are bounds until they are known."""
    values = {"feature": -1, "bin": -1, "left": -1, "depth": 0, "n0": rows / 2, "n1": rows / 2, "gain": 0}
    return {c: np.array([values[c]], kind) for c, kind in _COLUMNS.items()}
