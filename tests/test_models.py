"""Segments, churn features, training and evaluation."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storelens.operators import churn, evaluate, segments
from storelens.plans import experiments
from storelens.plans.mart import FIXED_CENTRES, Mart


def scores_table(spark, n=400, seed=3):
    source = random.Random(seed)
    rows = [(f"c{i}", source.randrange(400), source.randrange(1, 6), float(source.randrange(1, 900)),
             source.randrange(1, 5), source.randrange(1, 5), source.randrange(1, 5)) for i in range(n)]
    return spark.createDataFrame(
        rows, "customer_unique_id string, recency int, frequency int, monetary double, "
              "R_score int, F_score int, M_score int")


def plain_silhouette(points, labels):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_silhouette(spark):
    clustered = segments.assign_to_centres(scores_table(spark), FIXED_CENTRES)
    pdf = clustered.toPandas()
    x = pdf[["R_score", "F_score", "M_score"]]
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    assert segments.silhouette(clustered).first()[0] == pytest.approx(
        plain_silhouette(z, pdf["cluster"].to_numpy()))


def test_silhouette_of_single_customers_is_zero(spark):
    rows = [(1, 1, 1, 0), (4, 4, 4, 1)]
    df = spark.createDataFrame(rows, "R_score int, F_score int, M_score int, cluster int")
    assert segments.silhouette(df).first()[0] == 0.0


def test_ties_go_to_the_lowest_centre(spark):
    df = spark.createDataFrame([(2, 2, 2)], "R_score int, F_score int, M_score int")
    assert segments.assign_to_centres(df, [(3, 2, 2), (1, 2, 2)]).first()["cluster"] == 0


def test_kmeans_and_elbow(spark):
    scores = scores_table(spark)
    out = segments.kmeans_segments(scores, k=4, n_init=2).toPandas()
    assert len(out) == 400 and set(out["cluster"]) == {0, 1, 2, 3}
    assert out.groupby(["R_score", "F_score", "M_score"])["cluster"].nunique().max() == 1
    by_k = segments.silhouette_by_k(scores, range(2, 5), n_init=2)
    rows = by_k.collect()
    inertias = [r["inertia"] for r in rows]
    assert inertias == sorted(inertias, reverse=True)
    assert [r["inertia"] for r in segments.elbow(scores, range(2, 5), n_init=2).collect()] == pytest.approx(inertias)
    best = max(rows, key=lambda r: (r["silhouette"], -r["k"]))["k"]
    assert segments.best_k(by_k).first()["best_k"] == best


def test_inertia_is_in_standard_units(spark):
    scores = scores_table(spark)
    inertia = segments.elbow(scores, range(2, 3), n_init=3).first()["inertia"]
    pdf = scores.toPandas()[["R_score", "F_score", "M_score"]]
    z = (pdf - pdf.mean()) / pdf.std(ddof=0)
    assert 0 < inertia < float((z**2).to_numpy().sum()) == pytest.approx(1200)


def test_repeated_labels_are_numbered(spark):
    rows = [(f"c{i}", i % 5, 10 if i % 5 < 2 else 500 + i % 5, 1, 1000.0 if i % 5 < 2 else 10.0) for i in range(50)]
    df = spark.createDataFrame(rows, "customer_unique_id string, cluster int, recency int, frequency int, monetary double")
    df = df.withColumns({c: F.lit(1) for c in ("R_score", "F_score", "M_score")})
    profile = segments.segment_profile(df)
    labels = [r["label"] for r in profile.collect()]
    assert labels[:2] == ["Loyal", "Loyal_2"] and labels[2] == "Loyal_3" or len(set(labels)) == 5
    assert sum(r["pct"] for r in profile.collect()) == pytest.approx(100)
    table = segments.segment_table(df, profile)
    assert table.count() == 50 and table.where("segment IS NULL").count() == 0


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1, 5), (3, 5)], "a int, b int")
    out = segments.standardise(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["z_a"], r["z_b"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, prediction int")


@pytest.mark.parametrize("rows,auc", [
    ([(0, 0.1, 0), (0, 0.2, 0), (1, 0.8, 1), (1, 0.9, 1)], 1.0),
    ([(1, 0.1, 0), (1, 0.2, 0), (0, 0.8, 1), (0, 0.9, 1)], 0.0),
    ([(0, 0.5, 0), (1, 0.5, 0), (0, 0.5, 0)], 0.5),
])
def test_auc(spark, rows, auc):
    assert evaluate.roc_auc(scored(spark, rows)).first()[0] == auc


def test_auc_equals_pairs(spark):
    source = random.Random(4)
    rows = [(source.randrange(2), source.randrange(20) / 20, 0) for _ in range(300)]
    wins = [(p[1] > n[1]) + 0.5 * (p[1] == n[1]) for p in rows for n in rows if p[0] and not n[0]]
    assert evaluate.roc_auc(scored(spark, rows)).first()[0] == pytest.approx(np.mean(wins))


def test_metrics_without_positive_predictions(spark):
    df = scored(spark, [(1, 0.1, 0), (0, 0.1, 0)])
    assert tuple(evaluate.classification_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in evaluate.confusion(df).collect()] == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)]


def test_roc_curve_ends_in_the_corners(spark):
    points = evaluate.roc_curve(scored(spark, [(0, 0.1, 0), (1, 0.8, 1), (0, 0.8, 1)])).collect()
    assert [tuple(r)[1:] for r in points] == [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]


def test_comparison_marks_the_first_of_equals(spark):
    same = scored(spark, [(0, 0.1, 0), (1, 0.8, 1)])
    worse = scored(spark, [(1, 0.1, 0), (0, 0.8, 1)])
    rows = evaluate.model_comparison({"a": worse, "b": same, "c": same}).collect()
    assert [(r["model"], r["is_best"]) for r in rows] == [("a", False), ("b", True), ("c", False)]


def test_features_match_pandas(spark, mart):
    fact = mart.fact_sales
    pdf = fact.select(
        "customer_unique_id", "order_id", "order_item_id", "product_id", "seller_id", "payment_type",
        "product_category_name_english", "order_purchase_timestamp", "payment_installments",
        F.col("total_amount").cast("double"), F.col("freight_value").cast("double")).toPandas()
    g = pdf.groupby("customer_unique_id")
    expected = pd.DataFrame({
        "frequency": g["order_id"].nunique(), "monetary": g["total_amount"].sum(),
        "avg_order_value": g["total_amount"].mean(), "total_freight": g["freight_value"].sum(),
        "n_items": g["order_item_id"].count(), "n_products": g["product_id"].nunique(),
        "n_categories": g["product_category_name_english"].nunique(), "n_sellers": g["seller_id"].nunique(),
        "n_payment_methods": g["payment_type"].nunique(), "avg_installments": g["payment_installments"].mean(),
    })
    found = churn.churn_features(fact, mart.reviews).toPandas().set_index("customer_unique_id").loc[expected.index]
    for c in expected:
        assert np.allclose(found[c].astype(float), expected[c].astype(float)), c
    assert found[list(churn.FEATURES)].notna().all().all()


def test_reviews_count_each_order_once(spark, make_fact):
    fact = make_fact([{"order_id": "o1", "customer_unique_id": "a"}, {"order_id": "o1", "customer_unique_id": "a"},
                      {"order_id": "o2", "customer_unique_id": "b"}])
    reviews = spark.createDataFrame([("o1", 5), ("o1", 2)], "order_id string, review_score int")
    out = {r[0]: tuple(r)[1:] for r in churn.customer_reviews(fact, reviews).collect()}
    assert out == {"a": (3.5, 2), "b": (None, 0)}


def test_imputation(spark):
    rows = [(1.0, 1), (float("inf"), None), (3.0, 3), (None, 4), (float("-inf"), 5), (float("nan"), 6)]
    df = spark.createDataFrame(rows, "a double, b int")
    out = churn.impute_median(df, ["a", "b"]).collect()
    assert [r["a"] for r in out] == [1.0, 2.0, 3.0, 2.0, 2.0, 2.0]
    assert [r["b"] for r in out] == [1.0, 4.0, 3.0, 4.0, 5.0, 6.0]


def test_split_is_stable_and_stratified(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("customer_unique_id"),
                                  (F.col("id") % 4 == 0).cast("int").alias("churn"))
    once = churn.stratified_split(df)
    again = churn.stratified_split(df.repartition(11))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    shares = [r["s"] for r in once.groupBy("churn").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect()]
    assert all(0.17 < s < 0.23 for s in shares)
    exact = churn.stratified_split(df, exact=True).groupBy("churn").agg(F.count_if("is_test").alias("n"))
    assert {r["churn"]: r["n"] for r in exact.collect()} == {0: 750, 1: 250}


def test_weights_balance_the_classes(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "churn int")
    out = {r["churn"]: r["weight"] for r in churn.class_weights(df).collect()}
    assert out == {0: 4 / 6, 1: 2.0}


def test_label_starts_after_the_threshold(spark):
    df = spark.createDataFrame([(180,), (181,)], "recency int")
    assert [r["churn"] for r in churn.label_churn(df).collect()] == [0, 1]


SETTINGS = {"max_iter": 30, "trees": 10, "tree_depth": 5, "rounds": 5, "round_depth": 3}


def test_models_learn_score_and_are_kept(spark, mart, tmp_path):
    trained = experiments.train_models(mart.churn_features, **SETTINGS)
    rows = {r["model"]: r for r in trained.comparison().collect()}
    assert set(rows) == {"LogisticRegression", "RandomForest", "GradientBoosting"}
    assert all(0 <= r["roc_auc"] <= 1 for r in rows.values())
    importance = churn.feature_importance(trained.models["RandomForest"], n=5).collect()
    assert len(importance) == 5 and importance[0]["importance"] >= importance[4]["importance"]
    tables = experiments.churn_build(mart.churn_features, str(tmp_path), **SETTINGS)
    stored = spark.read.parquet(f"{tmp_path}/customer_churn")
    assert stored.count() == mart.rfm.count() == tables["customer_churn"].count()
    assert stored.where("churn_probability < 0 OR churn_probability > 1").count() == 0
    assert stored.where("(churn_probability > 0.5) <> (churn_prediction = 1)").count() == 0


def test_model_survives_saving(spark, mart, tmp_path):
    from storelens.sources.tables import load_model, save_model

    model = churn.train_lr(mart.churn_features, max_iter=10)
    save_model(model, f"{tmp_path}/lr")
    before = churn.score_customers(model, mart.churn_features).orderBy("customer_unique_id").collect()
    after = churn.score_customers(load_model(f"{tmp_path}/lr"), mart.churn_features)
    assert after.orderBy("customer_unique_id").collect() == before


def test_tracked_runs_are_recorded(spark, mart, tmp_path):
    path = f"{tmp_path}/runs"
    trained = experiments.tracked_experiment(mart.customer_segments, path, **SETTINGS)
    experiments.log_trained(trained, path)
    runs = spark.read.parquet(path).collect()
    assert len(runs) == 6
    assert {r["run_name"] for r in runs} == set(trained.models)
    assert all(r["params"]["n_features"] == "7" and 0 <= r["metrics"]["roc_auc"] <= 1 for r in runs)


def test_mart_without_fixed_centres_uses_kmeans(spark, mart):
    own = Mart(mart.raw, min_purchases=10)
    own.__dict__["rfm_scores"] = mart.rfm_scores
    assert own.customer_segments.select("segment").distinct().count() == 5


def test_missing_amounts_and_dates(spark, make_fact):
    """No amount counts as 0 and scores lowest; no date leaves no recency, no score and no cell."""
    from storelens.operators import rfm as r
    from storelens.operators import segments as s

    rows = [dict(customer_unique_id=f"c{i}", order_id=f"o{i}", order_item_id=1, total_amount=10 * i,
                 order_purchase_timestamp=f"2020-01-{i + 1:02}T00:00:00") for i in range(1, 9)]
    rows.append(dict(customer_unique_id="no-amount", order_id="x", order_item_id=1,
                     order_purchase_timestamp="2020-01-05T00:00:00"))
    rows.append(dict(customer_unique_id="no-date", order_id="y", order_item_id=1, total_amount=500))
    scores = r.rfm_scores(r.rfm(make_fact(rows)))
    by_id = {x["customer_unique_id"]: x for x in scores.collect()}
    assert by_id["no-amount"]["monetary"] == 0 and by_id["no-amount"]["M_score"] == 1
    assert by_id["no-date"]["recency"] is None and by_id["no-date"]["R_score"] is None
    assert by_id["no-date"]["RFM_score"] is None and by_id["no-date"]["M_score"] == 4
    assert s.score_cells(scores).agg({"n": "sum"}).first()[0] == 9
    clustered = s.assign_to_centres(scores, [(4, 4, 4), (1, 1, 1)])
    assert clustered.count() == 9
    assert s.segment_profile(clustered).agg({"n_customers": "sum"}).first()[0] == 9


def test_a_model_is_fitted_only_when_asked_for(spark, mart, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("nobody asked for this model")

    monkeypatch.setattr(churn, "train_lr", refuse)
    monkeypatch.setattr(churn, "train_gbt", refuse)
    trained = experiments.train_models(mart.churn_features, **SETTINGS)
    assert trained.tested["RandomForest"].count() > 0
    assert trained.models["RandomForest"] is trained.models["RandomForest"]


def test_models_are_fitted_side_by_side(spark):
    import threading

    all_here = threading.Barrier(3, timeout=20)
    tested = experiments.Fitted({name: all_here.wait for name in "abc"})
    experiments.Trained({}, tested, ()).fit_all()  # a fit that waits for the one before breaks the barrier
    assert sorted(tested.values()) == [0, 1, 2]


def test_training_rows_are_in_equal_parts(spark, monkeypatch):
    monkeypatch.setattr(experiments, "ROWS_A_TASK", (10, 50))
    rows = experiments._evenly(spark.range(1000).coalesce(1))
    assert rows.count() == rows.distinct().count() == 1000 and len(rows.inputFiles()) == 21
