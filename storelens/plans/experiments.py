"""Training, comparing and recording churn models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators import churn, evaluate
from storelens.session import materialize
from storelens.sources.tables import log_run, save_model, save_tables

TEST_SHARE = 0.2
ROWS_A_TASK = 20_000, 250_000  # training rows of a task: the fewest worth one, and the most


class Fitted(Mapping):
    """Values by name, each made when first asked for and then kept."""

    def __init__(self, makers: dict[str, Callable[[], Any]]) -> None:
        self._makers, self._made = makers, {}
        self._locks = {name: Lock() for name in makers}

    def __getitem__(self, name: str) -> Any:
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = self._makers[name]()
            return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Trained:
    """Models by name with their scored test rows; a model that nobody asks for is not fitted."""

    models: Mapping[str, PipelineModel]
    tested: Mapping[str, DataFrame]
    features: tuple[str, ...]
    params: dict[str, dict] = field(default_factory=dict)
    _comparison: DataFrame | None = None

    def fit_all(self) -> None:
        """Fit and test what is not yet, side by side: a step of one model leaves cores idle that another can use."""
        run = inheritable_thread_target(SparkSession.active())
        with ThreadPoolExecutor(len(self.tested)) as pool:
            list(pool.map(run(self.tested.__getitem__), self.tested))

    def comparison(self) -> DataFrame:
        """Computed once; three rows."""
        if self._comparison is None:
            self.fit_all()
            self._comparison = materialize(
                evaluate.model_comparison(self.tested).coalesce(1), "model-comparison")
        return self._comparison

    def best(self) -> str:
        return self.comparison().where("is_best").first()["model"]


def _evenly(train: DataFrame) -> DataFrame:
    """The rows written in equal parts, for all cores if there are enough; the fits pass over them many times."""
    fewest, most = ROWS_A_TASK
    rows = train.count()
    parts = max(min(train.sparkSession.sparkContext.defaultParallelism, 1 + rows // fewest), 1 + rows // most)
    return materialize(train.repartition(parts), "training-rows")


def train_models(
    labelled: DataFrame,
    features: tuple[str, ...] = churn.FEATURES,
    trees: int = 200,
    tree_depth: int = 15,
    rounds: int = 200,
    round_depth: int = 6,
    max_iter: int = 1000,
    seed: int = 42,
) -> Trained:
    """Logistic regression, forest and boosted trees on the same split, each fitted when it is asked for."""
    split = churn.stratified_split(labelled, test=TEST_SHARE, seed=seed)
    train, test = _evenly(split.where(~F.col("is_test"))), split.where("is_test")
    models = Fitted({
        "LogisticRegression": lambda: churn.train_lr(train, features, max_iter),
        "RandomForest": lambda: churn.train_rf(train, trees, tree_depth, features, seed),
        "GradientBoosting": lambda: churn.train_gbt(
            train, rounds, round_depth, features=features, seed=seed
        ),
    })

    def tested_by(name: str) -> DataFrame:
        """Written, so that each metric does not run the model again."""
        found = churn.predict(models[name], test)
        return materialize(
            evaluate.scored(found, "churn", "churn_probability", "churn_prediction"), "scored-test-rows")

    tested = Fitted({name: lambda name=name: tested_by(name) for name in models})
    params = {
        "LogisticRegression": {"C": 1.0, "max_iter": max_iter, "needs_scaling": True},
        "RandomForest": {"n_estimators": trees, "max_depth": tree_depth, "needs_scaling": False},
        "GradientBoosting": {"n_estimators": rounds, "max_depth": round_depth, "needs_scaling": False},
    }
    return Trained(models, tested, features, params)


def log_trained(trained: Trained, path: str, models: str | None = None) -> None:
    """One row per model in the run table at `path`; the fitted models under `models`, if given."""
    trained.fit_all()
    for name, scored in trained.tested.items():
        metrics = evaluate.all_metrics(scored).first().asDict()
        params = {
            "model_type": name,
            "test_size": TEST_SHARE,
            "n_features": len(trained.features),
            **trained.params[name],
        }
        if models is not None:
            params["model_path"] = f"{models.rstrip('/')}/{name}"
            save_model(trained.models[name], params["model_path"])
        log_run(scored.sparkSession, name, params, metrics, path)


def tracked_experiment(
    segments: DataFrame, path: str, models: str | None = None, **settings: int
) -> Trained:
    """The tracked variant: seven features from the segment table, every run and its model recorded."""
    labelled = churn.tracked_features(segments)
    trained = train_models(labelled, churn.TRACKED_FEATURES, **settings)
    log_trained(trained, path, models)
    return trained


def best_run(runs: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The logged run with the highest metric, the earliest and then the first name on ties."""
    order = [F.col("metrics")[metric].desc_nulls_last(), "logged_at", "run_name"]
    return runs.orderBy(*order).limit(1)


def churn_build(features: DataFrame, folder: str, **settings: int) -> dict[str, DataFrame]:
    """Train on labelled, imputed features, keep the best model and score every customer."""
    trained = train_models(features, **settings)
    best = trained.best()
    model = trained.models[best]
    save_model(model, f"{folder.rstrip('/')}/models/churn_{best}")
    tables = {
        "customer_churn": churn.score_customers(model, features),
        "churn_model_comparison": trained.comparison(),
    }
    save_tables(tables, folder, sort_by={"customer_churn": ["customer_unique_id"]})
    return tables
