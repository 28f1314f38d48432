"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A pandas table without its index; for small inputs."""
    return spark.createDataFrame(frame.reset_index(drop=True))


def to_pandas(df: DataFrame, order: str | None = "effective_from"):
    """A small result, in order of its start."""
    return (df.orderBy(order) if order else df).toPandas()


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any source that Spark reads; columns and filters are pushed down by it."""
    return spark.read.format(format).options(**options).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)
