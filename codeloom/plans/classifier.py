"""A binary text classifier with Spark ML: train, evaluate, evaluate only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.tokens import TOKEN_PATTERN
from codeloom.operators.metrics import binary_metrics
from codeloom.session import written


def held_out(text: Column, percent: int = 20) -> Column:
    """Whether a row is held out: by content, so equal contents never sit on both sides."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100)) < percent


def hashed(
    rows: DataFrame, text: str = "func", features: int = 1 << 18, keep: Sequence[str] = (), spread: int | None = None
) -> DataFrame:
    """Term counts of each text as a hashed vector ``_tf``, written once; texts are not looked at again.

    Row-local, so texts are not shuffled. ``spread`` deals the vectors out to as many tasks for the
    passes of the fit; without it they stay in the parts that the texts were read in.
    """
    vectors = PipelineModel(_hashing(text, features)).transform(rows).select(*keep, "_tf")
    return written(vectors.repartition(spread) if spread else vectors, "features")


def _hashing(text: str, features: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
    ]


def fit(vectors: DataFrame, label: str = "labels", extra: str | None = None, iterations: int = 20) -> PipelineModel:
    """IDF and logistic regression on vectors of ``hashed``.

    Without ``extra`` the vectors go straight to the regression: an assembler would list every
    hashed feature in the schema.
    """
    combine = [VectorAssembler(inputCols=["_idf", extra], outputCol="_features")] if extra else []
    stages = [
        IDF(inputCol="_tf", outputCol="_idf"),
        *combine,
        LogisticRegression(
            featuresCol="_features" if extra else "_idf",
            labelCol=label,
            predictionCol="_prediction",
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            maxIter=iterations,
        ),
    ]
    return Pipeline(stages=stages).fit(vectors)


def train(
    rows: DataFrame,
    text: str = "func",
    label: str = "labels",
    extra: str | None = None,
    features: int = 1 << 18,
    iterations: int = 20,
) -> PipelineModel:
    """Fit hashed TF-IDF and logistic regression; ``extra`` is a vector column to add (structure).

    Texts are read once, whatever the number of passes; the model takes texts.
    """
    vectors = hashed(rows, text, features, keep=[label, *([extra] if extra else [])])
    return PipelineModel([*_hashing(text, features), *fit(vectors, label, extra, iterations).stages])


def train_and_evaluate(
    rows: DataFrame,
    text: str = "func",
    label: str = "labels",
    extra: str | None = None,
    features: int = 1 << 18,
    iterations: int = 20,
    percent: int = 20,
    spread: int | None = None,
) -> DataFrame:
    """Metrics on the rows that ``held_out`` sets apart, of a model fitted on the others.

    Both sides are hashed in one pass over the texts.
    """
    sided = rows.withColumn("_held", held_out(F.col(text), percent))
    vectors = hashed(sided, text, features, [label, "_held", *([extra] if extra else [])], spread)
    model = fit(vectors.where("NOT _held"), label, extra, iterations)
    return evaluate(model, vectors.where("_held"), label)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with an integer ``predicted``."""
    scored = model.transform(rows).withColumn("predicted", F.col("_prediction").cast("int"))
    return scored.select(*rows.columns, "predicted")


def evaluate(model: PipelineModel, rows: DataFrame, label: str = "labels") -> DataFrame:
    """Metrics of class 1 on labelled rows."""
    return binary_metrics(predict(model, rows), label)
