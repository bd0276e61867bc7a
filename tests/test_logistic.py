from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from storelens.operators import logistic


def rows(spark, n=400, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.randn(n, 3) * [1, 10, 0.1] + [0, 5, 1]
    y = (x @ [1, -0.2, 5] - 4 + rng.randn(n) > 0).astype(int)
    return spark.createDataFrame(
        [(*map(float, v), int(t), 1.0 + int(t)) for v, t in zip(x, y)],
        "a double, b double, c double, churn int, weight double")


def fitted(df):
    scaling, scaled, x = logistic.scaled(df, ("a", "b", "c"), F.col("churn"), F.col("weight"))
    return scaling, scaled, x, logistic.newton(scaled, x, F.col("churn"), F.col("weight"))


def loss(z, y, w, beta):
    margin = z @ beta[:-1] + beta[-1]
    return (w * (np.logaddexp(0, margin) - y * margin)).sum() + 0.5 * beta[:-1] @ beta[:-1]


def test_newton_reaches_the_least_loss(spark):
    _, scaled, x, fit = fitted(rows(spark))
    beta = np.r_[fit.coefficients, fit.intercept]
    slope = logistic.gradient(scaled, x, F.col("churn"), F.col("weight"), beta)
    assert np.linalg.norm(slope) < 1e-8 and fit.steps < 15
    data = np.array([tuple(r) for r in scaled.collect()], float)
    z, y, w = data[:, :3], data[:, 3], data[:, 4]
    rng = np.random.RandomState(3)
    least = loss(z, y, w, beta)
    assert all(loss(z, y, w, beta + 0.01 * rng.randn(4)) > least for _ in range(50))


def test_model_is_stored_and_applied_as_any_other(spark, tmp_path):
    df = rows(spark)
    scaling, scaled, _, fit = fitted(df)
    model = logistic.as_model(scaling, fit, "churn")
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    found = [r["probability"][1] for r in again.transform(df).select("probability").collect()]
    assert found == [r["probability"][1] for r in model.transform(df).select("probability").collect()]
    z = np.array([tuple(r)[:3] for r in scaled.collect()])
    assert np.allclose(sorted(found), sorted(1 / (1 + np.exp(-(z @ fit.coefficients + fit.intercept)))))


def test_constant_features_no_rows_and_separable_rows(spark):
    df = rows(spark).withColumn("b", F.lit(2.0))
    fit = fitted(df)[3]
    assert abs(fit.coefficients[1]) < 1e-9 and np.isfinite(fit.intercept)
    apart = df.withColumn("a", F.when(F.col("churn") == 1, 3.0).otherwise(-3.0))
    assert fitted(apart)[3].norm < 1e-6  # the penalty keeps the optimum finite
    _, scaled, x, _ = fitted(df)
    none = logistic.newton(scaled.where("churn > 5"), x, F.col("churn"), F.col("weight"))
    assert none.steps == 0 and not none.coefficients.any()
