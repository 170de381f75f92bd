"""Model bundles: MLlib stages and small parameter tables below one folder."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

# The parts a complete bundle holds.
MODEL_PARTS = ["labels", "classifier", "maximum", "minimum"]
TABLE_PARTS = ["forecaster", "columns"]


def save_bundle(models: dict[str, PipelineModel], tables: dict[str, DataFrame], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
    """The parts that exist; a part that was never written is simply absent."""
    models, tables = {}, {}
    for name in MODEL_PARTS:
        try:
            models[name] = PipelineModel.load(f"{path}/{name}")
        except (AnalysisException, Py4JJavaError, ValueError) as error:
            if not absent(error):
                raise
    for name in TABLE_PARTS:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if not absent(error):
                raise
    return models, tables


def absent(error: Exception) -> bool:
    text = str(error)
    return any(mark in text for mark in ("PATH_NOT_FOUND", "does not exist", "InvalidInputException"))
