"""Logistic regression by Newton's method, with a proof that its optimum was reached.

The loss is that of the sum of weighted rows plus half the squared coefficients (the intercept goes free). Its gradient
and curvature are sums over rows of products of two features, so one aggregate gives both; what comes to the driver is a
matrix of as many rows as there are features, whatever the number of rows. The loss is convex, so a gradient of
zero is the optimum, and `gradient` states it for any coefficients.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

TOLERANCE = 1e-13  # of the gradient's norm, relative to the rows' weight
SETTLED = 1e-9  # below which a norm that no longer halves is rounding


@dataclass
class Fit:
    coefficients: np.ndarray
    intercept: float
    steps: int
    norm: float


def _margin(x: list[Column], beta: np.ndarray) -> Column:
    total = F.lit(float(beta[-1]))
    for c, b in zip(x, beta[:-1]):
        total = total + c * F.lit(float(b))
    return total


def _probability(margin: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(margin))
    return F.when(margin >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def gradient(
    rows: DataFrame, x: list[Column], label: Column, weight: Column, beta: np.ndarray, penalty: float = 1.0
) -> np.ndarray:
    """The gradient of the penalised loss at beta (the intercept last), by one aggregate."""
    miss = weight * (_probability(_margin(x, beta)) - label)
    sums = rows.agg(*[F.sum(miss * c) for c in [*x, F.lit(1.0)]]).first()
    return np.array([float(s or 0.0) for s in sums]) + penalty * np.r_[beta[:-1], 0.0]


def _sums(rows: DataFrame, beta: np.ndarray) -> np.ndarray | None:
    """Every sum of a step from one pass: loss, weight, gradient and curvature; None without rows.

    A task multiplies whole batches and sends one row, so their number is that of the tasks.
    """

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(2 + len(beta) + len(beta) ** 2)
        seen = 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            label, weight = columns[-2:]
            x = np.column_stack([*columns[:-2], np.ones(batch.num_rows)])
            margin = x @ beta
            e = np.exp(-np.abs(margin))
            p = np.where(margin >= 0, 1 / (1 + e), e / (1 + e))
            loss = np.maximum(margin, 0.0) + np.log1p(e) - label * margin
            curve = x.T @ (x * (weight * p * (1 - p))[:, None])
            sums += np.r_[weight @ loss, weight.sum(), x.T @ (weight * (p - label)), curve.ravel()]
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    found = rows.mapInArrow(add, "sums array<double>").collect()
    return np.sum([r["sums"] for r in found], axis=0) if found else None


def newton(
    rows: DataFrame, x: list[Column], label: Column, weight: Column,
    penalty: float = 1.0, max_iter: int = 100, tolerance: float = TOLERANCE,
) -> Fit:
    """The coefficients of least penalised loss for rows of standardised features x.

    Each step solves the curvature for the gradient and is halved as long as the loss would rise. Rows with a NULL in
    a feature, label or weight are left out. No rows: all zero. One class only: the intercept goes as far as
    `max_iter` steps take it.
    """
    size = len(x) + 1
    known = rows.select(
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], label.cast("double").alias("label"),
        weight.cast("double").alias("weight")).dropna()
    beta = best = move = np.zeros(size)
    ridge = penalty * np.diag(np.r_[np.ones(size - 1), 0.0])
    norm, step, best_loss = np.inf, 0, np.inf
    for step in range(max_iter + 1):
        got = _sums(known, beta)
        if got is None:
            return Fit(beta[:-1], 0.0, 0, 0.0)
        loss = got[0] + penalty / 2 * float(beta[:-1] @ beta[:-1])
        slope = got[2:2 + size] + penalty * np.r_[beta[:-1], 0.0]
        last, norm = norm, float(np.linalg.norm(slope))
        stuck = norm <= SETTLED * got[1] and norm > last / 2
        if norm <= tolerance * got[1] or stuck or step == max_iter:
            break
        if step and loss > best_loss + 1e-12 * abs(best_loss):
            move = move / 2  # back half way
            if np.abs(move).max() < 1e-14:
                break
            beta = best + move
            continue
        curve = got[2 + size:].reshape(size, size) + ridge + 1e-12 * np.eye(size)
        best, best_loss = beta, loss
        move = -np.linalg.solve(curve, slope)
        beta = beta + move
    return Fit(beta[:-1], float(beta[-1]), step, norm)


def scaled(df: DataFrame, features: tuple[str, ...], *keep: Column) -> tuple[PipelineModel, DataFrame, list[Column]]:
    """The fitted standardisation, its rows written once (with what is to be kept), and their feature columns."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    assembled = assembler.transform(df)
    model = scaler.fit(assembled)
    names = [f"z{i}" for i in range(len(features))]
    values = vector_to_array("features")
    rows = model.transform(assembled).select(*[values[i].alias(n) for i, n in enumerate(names)], *keep)
    return PipelineModel(stages=[assembler, model]), materialize(rows, "scaled-rows"), [F.col(n) for n in names]


def as_model(scaling: PipelineModel, fit: Fit, label: str) -> PipelineModel:
    """A Spark model of the fitted coefficients, so that it is stored, loaded and applied as any other."""
    gateway = SparkSession.active().sparkContext._gateway
    values = gateway.new_array(gateway.jvm.double, len(fit.coefficients))
    for i, c in enumerate(fit.coefficients):
        values[i] = float(c)
    vector = gateway.jvm.org.apache.spark.ml.linalg.DenseVector(values)
    uid = f"newton-{scaling.stages[-1].uid}"
    made = LogisticRegressionModel(
        gateway.jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, vector, fit.intercept))
    made._resetUid(uid)
    made.setFeaturesCol("features")
    made.set(made.labelCol, label)
    return PipelineModel(stages=[*scaling.stages, made])
