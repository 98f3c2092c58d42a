"""Boosted-tree training and prediction with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.operators.columns import select_features
from emberfield.operators.impute import apply_medians, fit_medians
from emberfield.operators.stats import class_balance, regression_metrics
from emberfield.operators.temporal import hotspot_label, proxy_lags, temporal_features, train_val_test_split
from emberfield.scale import cut_lineage, hash_uniform, shared_dir

TARGET = "lst_celsius"


@dataclass
class TreeParams:
    """Names on the left of the usual booster parameters: rounds, depth, rate, row and column share, leaf size, bins."""

    rounds: int = 50
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    min_leaf: int = 3
    bins: int = 64
    seed: int = 42
    stop_tol: float | None = None
    """Least relative gain on validation rows that another round must bring; None runs all rounds."""

    def settings(self) -> dict:
        return dict(
            maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share), minInstancesPerNode=self.min_leaf, maxBins=self.bins,
            seed=self.seed, **({} if self.stop_tol is None else {"validationTol": self.stop_tol}),
            # rounds restart from shared files: node ids are kept and checkpointed every tenth round
            cacheNodeIds=True, checkpointInterval=10,
        )


# Tree counts, depths and rates of the two full-size trainers.
FULL_MAIN = TreeParams(rounds=800, depth=6, rate=0.03)
FULL_MODULE = TreeParams(rounds=1000, depth=7, rate=0.05)


@dataclass
class FittedTrees:
    """Medians of the training rows, the feature order and the fitted stage."""

    features: list[str]
    medians: dict[str, float]
    stage: object
    majority: int | None = None
    extra: dict = field(default_factory=dict)

    def assemble(self, df: DataFrame) -> DataFrame:
        ready = apply_medians(df.withColumn("_row", F.struct(*df.columns)), self.medians)
        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(ready)

    def __call__(self, df: DataFrame) -> DataFrame:
        """Input columns as they were, plus ``prediction`` (and ``probability`` of class 1 for a classifier)."""
        if self.majority is not None:
            share = F.lit(float(self.majority))
            return df.withColumns({"prediction": F.lit(float(self.majority)), "probability": share})
        out = self.stage.transform(self.assemble(df))
        kept = [F.col(f"_row.{c}").alias(c) for c in df.columns]
        if "probability" in out.columns:
            return out.select(*kept, "prediction", vector_to_array("probability")[1].alias("probability"))
        return out.select(*kept, "prediction")

    def save(self, path: str, spark: SparkSession) -> None:
        PipelineModel(stages=[self.stage]).write().overwrite().save(f"{path}/stage")
        rows = [(i, f, float(self.medians[f])) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, "i int, feature string, median double").coalesce(1).write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(path: str, spark: SparkSession) -> FittedTrees:
        rows = spark.read.schema("i int, feature string, median double").json(f"{path}/features").orderBy("i").collect()
        stage = PipelineModel.load(f"{path}/stage").stages[0]
        return FittedTrees([r["feature"] for r in rows], {r["feature"]: r["median"] for r in rows}, stage)


def _fit(
    train: DataFrame, features: list[str], label: str, maker, params: TreeParams, held: DataFrame | None = None,
    medians: dict[str, float] | None = None,
) -> FittedTrees:
    """Medians and trees of the training rows. With ``held`` and a ``stop_tol``, rounds end when the error on the held
    rows no longer falls by that share, and the model keeps the rounds up to its best one. ``medians`` of the same rows
    that another fit has found are taken over."""
    shared_dir(train.sparkSession)
    model = FittedTrees(features, fit_medians(train, features) if medians is None else dict(medians), None)
    watched = held is not None and params.stop_tol is not None and not held.isEmpty()
    rows = train.withColumn("_held", F.lit(False))
    if watched:
        rows = rows.unionByName(held.withColumn("_held", F.lit(True)))
    ready = model.assemble(rows).select("_features", F.col(label).cast("double").alias("_label"), "_held")
    settings = params.settings() | ({"validationIndicatorCol": "_held"} if watched else {})
    model.stage = maker(featuresCol="_features", labelCol="_label", **settings).fit(ready)
    return model


def prediction_frame(df: DataFrame, model, ids: Sequence[str], actual: str = TARGET) -> DataFrame:
    """split, ids, lon, lat, actual, predicted and residual."""
    out = model(df)
    where = [c for c in ("lon", "lat") if c in df.columns]
    return out.select(
        *[c for c in ("split",) if c in df.columns], *ids, *where, F.col(actual).alias("actual"),
        F.col("prediction").alias("predicted"), (F.col(actual) - F.col("prediction")).alias("residual"),
    )


def train_lst(
    df: DataFrame, ids: Sequence[str], features: Sequence[str] | None = None, optional: Sequence[str] = (),
    params: TreeParams = TreeParams(),
) -> tuple[FittedTrees, DataFrame, DataFrame]:
    """Fit the surface-temperature regressor on 80 % of the rows; returns the model, validation and test
    predictions, and their metrics. With ``params.stop_tol`` the validation rows end the fit."""
    rows = df.filter(F.col(TARGET).isNotNull())
    used = list(features) if features else select_features(rows, optional=optional)
    where = [c for c in ("lon", "lat") if c in df.columns and c not in used]
    narrow = rows.select(*dict.fromkeys([*ids, *where, TARGET, *used]))  # the split writes what it is given
    parts = cut_lineage(train_val_test_split(narrow, ids, seed=params.seed).select(*ids, *where, TARGET, "split", *used))
    model = _fit(parts.filter("split = 'train'"), used, TARGET, GBTRegressor, params, parts.filter("split = 'val'"))
    predictions = prediction_frame(parts.filter("split <> 'train'"), model, ids)
    return model, predictions, regression_metrics(predictions)


def prepare_future(df: DataFrame, key: str = "grid_id", order: Sequence[str] = ("date",)) -> DataFrame:
    """Temporal features and label; single-date tables get the stand-ins."""
    if "date" not in df.columns or df.select("date").distinct().limit(2).count() <= 1:
        return proxy_lags(df, ids=(key,))
    return hotspot_label(temporal_features(df, key, order), "date")


def train_future(
    df: DataFrame, ids: Sequence[str], features: Sequence[str] | None = None, params: TreeParams = TreeParams()
) -> tuple[FittedTrees, FittedTrees, DataFrame]:
    """Regression and hotspot classification on an 80/20 split, stratified when both classes have two rows.

    Returns both models and the scored test rows. A single class gives a constant predictor. With ``params.stop_tol``
    a tenth of the training rows, by hash, is held back to end both fits.

    The rows are made once, with no more columns than the models need: features, classes and split are read from there.
    """
    wanted = list(features) if features else S.FUTURE_BASE_FEATURES + S.FUTURE_TEMPORAL_FEATURES
    needed = dict.fromkeys([*ids, TARGET, "hotspot_label", *[c for c in wanted if c in df.columns]])
    rows = cut_lineage(df.filter(F.col(TARGET).isNotNull()).select(*needed))
    used = select_features(rows, wanted)
    balance = class_balance(rows).collect()
    both = len(balance) > 1
    stratify = "hotspot_label" if both and balance[0]["can_stratify"] else None
    parts = train_val_test_split(rows, ids, (0.8, 0.0, 0.2), params.seed, stratify)
    parts = cut_lineage(parts.select(*ids, TARGET, "hotspot_label", "split", *[c for c in used if c not in ids]))
    train, held = parts.filter("split = 'train'"), None
    if params.stop_tol is not None:
        back = hash_uniform(list(ids), f"{params.seed}:stop") < 0.1
        train, held = train.filter(~back), train.filter(back)
    reg = _fit(train, used, TARGET, GBTRegressor, params, held)
    if both:
        cls = _fit(train, used, "hotspot_label", GBTClassifier, params, held, reg.medians)
    else:
        cls = FittedTrees(used, {}, None, majority=int(balance[0]["hotspot_label"]) if balance else 0)
    test = reg(parts.filter("split = 'test'")).withColumnRenamed("prediction", "predicted_lst")
    scored = cls(test).withColumnsRenamed({"prediction": "predicted_label", "probability": "hotspot_prob"})
    return reg, cls, scored.select(
        *ids, TARGET, "hotspot_label", "predicted_lst", F.col("predicted_label").cast("int").alias("predicted_label"), "hotspot_prob"
    )


def feature_importance(model: FittedTrees, spark: SparkSession, n: int = 20) -> DataFrame:
    """The model's own importances, largest first."""
    scores = model.stage.featureImportances.toArray()
    rows = sorted(((f, float(s)) for f, s in zip(model.features, scores)), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")
