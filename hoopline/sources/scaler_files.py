"""The fitted scaler as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "version INT, feature_names ARRAY<STRING>, fitted_season STRING, means MAP<STRING, DOUBLE>, "
    "scales MAP<STRING, DOUBLE>, imputations MAP<STRING, DOUBLE>, binary_features ARRAY<STRING>"
)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """One row, so one file."""
    scaler.coalesce(1).write.mode("overwrite").json(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Read a scaler, whether written on one line or spread over many."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)
