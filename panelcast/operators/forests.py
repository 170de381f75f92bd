"""Forests on assembled features: classifier with balanced weights, regressors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.cluster import vector_stages


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (K * n_c) per class, from one grouped count.

    The window runs over the counted classes, one row each.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()
    total, classes = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def weight_column(weights: dict[float, float], label: str) -> Column:
    """The weight of a row's class; the few classes enter the plan as literals, not as a join."""
    out = F.lit(None).cast("double")
    for value, weight in sorted(weights.items()):
        out = F.when(F.col(label) == F.lit(value), F.lit(weight)).otherwise(out)
    return out


def fit_classifier(
    df: DataFrame,
    features: list[str],
    label: str,
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
    prediction: str = "predicted_label",
) -> PipelineModel:
    """Standardise, then a forest whose rows weigh by class; rows with gaps are not used.

    The forest passes over assembled vectors several times, so they alone are kept meanwhile; classes are counted on them.
    """
    rows = df.dropna(subset=[*features, label]).withColumn(label, F.col(label).cast("double"))
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        featuresCol="scaled",
        labelCol=label,
        weightCol="weight",
        predictionCol=prediction,
        rawPredictionCol="raw",
        probabilityCol="probability",
    )
    prepared = Pipeline(stages=vector_stages(features)).fit(rows)
    vectors = prepared.transform(rows).select("scaled", label).persist()
    try:
        weights = {r[label]: r["weight"] for r in class_weights(vectors, label).collect()}
        model = forest.fit(vectors.withColumn("weight", weight_column(weights, label)))
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*prepared.stages, model])


def fit_regressor(
    df: DataFrame,
    features: list[str],
    target: str,
    prediction: str,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> PipelineModel:
    vector, rows = f"{prediction}_features", df.dropna(subset=[*features, target])
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, featuresCol=vector, labelCol=target, predictionCol=prediction
    )
    assembler = VectorAssembler(inputCols=features, outputCol=vector, handleInvalid="keep")
    vectors = assembler.transform(rows).select(vector, target).persist()
    try:
        return PipelineModel(stages=[assembler, forest.fit(vectors)])
    finally:
        vectors.unpersist()


def apply_model(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Scored rows with only the wanted columns; rows with a missing feature are left out."""
    inputs = model.stages[0].getInputCols()
    return model.transform(df.dropna(subset=inputs)).select(*keep)


def apply_keeping_gaps(model: PipelineModel, df: DataFrame, prediction: str) -> DataFrame:
    """All rows; those with a missing feature have a NULL prediction."""
    known = F.lit(True)
    for name in model.stages[0].getInputCols():
        known = known & F.col(name).isNotNull()
    scored = model.transform(df)
    return scored.select(*df.columns, F.when(known, F.col(prediction)).alias(prediction))
