"""Models of the target: the families, calibration, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.boosting import NewtonBoosting
from tidemark.operators.features import NUMERIC, FeatureTransformer, check_blocked
from tidemark.sources.shared import new_path, written

SEED = 42


def families(trees: int | None = None) -> dict[str, object]:
    """The estimators by name. trees: fewer, for trials."""
    common = {"labelCol": "target", "featuresCol": "features", "weightCol": "weight"}
    return {
        "boosted": NewtonBoosting(maxIter=trees or 500, depth=4, stepSize=0.05, l2=1.0, leastCurvature=1.0, bins=256, rowPart=0.9, featurePart=0.9, seed=SEED, **common),
        "random_forest": RandomForestClassifier(numTrees=trees or 400, minInstancesPerNode=20, seed=SEED, **common),
        "logistic_regression": LogisticRegression(maxIter=1000, standardization=False, **common),
        "histogram_boosted": NewtonBoosting(maxIter=trees or 400, leaves=31, stepSize=0.05, l2=0.01, leastRows=20, patience=10, seed=SEED, **common),
    }


def pipeline(name: str, trees: int | None = None, numeric: Sequence[str] = NUMERIC) -> Pipeline:
    """Features, medians for what is missing, scaled for the logistic model, the state one-hot with unknown ones as
    none. numeric: the columns that the model sees beside the state; identity columns are refused."""
    if name not in families():
        raise ValueError(f"unknown model: {name}")
    numeric = list(numeric)
    check_blocked([*numeric, "state"])
    stages = [
        FeatureTransformer(),
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_f" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}_f" for c in numeric], outputCol="numeric"),
        StringIndexer(inputCol="state", outputCol="state_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="state_index", outputCol="state_vector", handleInvalid="keep"),
    ]
    if scaled := name == "logistic_regression":
        stages.append(StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["scaled" if scaled else "numeric", "state_vector"], outputCol="features"))
    return Pipeline(stages=[*stages, families(trees)[name]])


def balanced(df: DataFrame, label: str = "target", positives_only: bool = False) -> DataFrame:
    """df with the weight that balances the classes: 1 if there is but one. positives_only: negatives weigh 1, positives
    as many times as there are more negatives, at least 1."""
    n, p = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    if not p or p == n:
        return df.withColumn("weight", F.lit(1.0))
    if positives_only:
        return df.withColumn("weight", F.when(F.col(label) == 1, max(1.0, (n - p) / p)).otherwise(1.0))
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))


#: How a family weighs the classes; the others balance both.
WEIGHTS = {"boosted": lambda df: balanced(df, positives_only=True), "histogram_boosted": lambda df: df.withColumn("weight", F.lit(1.0))}


def train(df: DataFrame, name: str = "boosted", trees: int | None = None, calibration: DataFrame | None = None) -> PipelineModel:
    """The model of a family. calibration: rows, best not those of df, on which isotonic steps are fitted that become its
    last stage, so that a saved model gives calibrated probabilities."""
    df = dealt(df) if name == "random_forest" else df
    model = pipeline(name, trees).fit(WEIGHTS.get(name, balanced)(df))
    model = PipelineModel([*model.stages[:-1], _without_summary(model.stages[-1], df.sparkSession)])
    if calibration is None:
        return model
    seen = model.transform(calibration).withColumn("target", F.col("target").cast("double"))
    steps = IsotonicRegression(featuresCol="probability", featureIndex=1, labelCol="target", predictionCol=CALIBRATED).fit(seen)
    return PipelineModel([*model.stages, steps])


CALIBRATED = "calibrated_probability"
#: Rows of a task of a forest; its trees' work is far over what the rows' bytes tell, by which Spark would put them together.
FOREST_ROWS = 200_000


def dealt(df: DataFrame) -> DataFrame:
    """df written once, so that no fit of the pipeline works it out again, and dealt in a fixed order to tasks: three for
    each core at least, one for each FOREST_ROWS rows."""
    rows = written(df, "training")
    tasks = max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FOREST_ROWS))
    by = [c for c, kind in rows.dtypes if "map<" not in kind]
    return rows.repartition(tasks, *by).sortWithinPartitions(*by)


def _without_summary(stage: Model, spark: SparkSession) -> Model:
    """The stage as it is when loaded: a training summary holds the session, which can't be sent to tasks once a frame has
    been observed in it."""
    if not getattr(stage, "hasSummary", False):
        return stage
    path = new_path(spark, "model")
    stage.write().save(path)
    return type(stage).load(path)


def predict(model: PipelineModel, df: DataFrame, column: str = "risk_score") -> DataFrame:
    """df with the chance of the target; calibrated, if the model is."""
    made = model.transform(df)
    chance = F.col(CALIBRATED) if isinstance(model.stages[-1], IsotonicRegressionModel) else F.get(vector_to_array("probability"), F.lit(1))
    return made.select(*df.columns, chance.alias(column))


def calibrate(scored: DataFrame, score: str = "risk_score", label: str = "target") -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(scored.withColumn(label, F.col(label).cast("double")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
