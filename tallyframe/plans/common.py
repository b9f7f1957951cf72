"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.variables import Variable, VariableMap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str, name: str, *variables: Variable, weight: str | None = None) -> SurveyData:
    return SurveyData(table(spark, sf_dir, name), VariableMap(variables), weight=weight)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select([F.round(f"`{f.name}`", places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def one_row(spark: SparkSession, places: int = 6, **values) -> DataFrame:
    """Scalar results as a row, made of literals."""
    return spark.range(1).select([F.lit(round(v, places) if isinstance(v, float) else v).alias(k) for k, v in values.items()])


def renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)
