"""Bitemporal inputs made of the driver's tables, and the constants of the queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.constants import INFINITY
from chronolith.operators.normalize import instant

IDS, VALUES = ["o_custkey"], ["o_orderstatus", "o_totalprice"]
KNOWN_PAST, KNOWN_NOW, BATCH = datetime(1999, 1, 1), datetime(2000, 1, 1), datetime(2000, 1, 2)
SYSTEM_DATE = "2000-01-01"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*cols).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a history: an order holds until the next day with one."""
    first = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    rows = orders(spark, sf_dir).withColumn("k", F.row_number().over(first)).where("k = 1")
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
    return rows.select(
        *IDS, *VALUES, F.col("o_orderdate").alias("effective_from"), F.coalesce(until, instant(INFINITY)).alias("effective_to"),
        instant(KNOWN_PAST).alias("as_of_from"), instant(INFINITY).alias("as_of_to"),
    )


def update_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order again, from 15 to 75 days later; every other one at a new price."""
    rows = orders(spark, sf_dir).where("o_orderkey % 7 = 0")
    price = F.when(F.col("o_orderkey") % 14 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1000)
    return rows.select(
        "o_custkey", "o_orderstatus", price.alias("o_totalprice"),
        (F.col("o_orderdate") + F.expr("interval 15 days")).alias("effective_from"), (F.col("o_orderdate") + F.expr("interval 75 days")).alias("effective_to"),
        instant(KNOWN_NOW).alias("as_of_from"), instant(INFINITY).alias("as_of_to"), "o_orderkey",
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as adjacent segments, with a coarse value so that runs repeat."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type", "ts").orderBy("event_id"))).where("k = 1")
    until = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    return rows.select(
        "user_id", "event_type", F.floor(F.col("value") / 50).cast("bigint").alias("bucket"), F.col("ts").alias("effective_from"),
        F.coalesce(until, instant(INFINITY)).alias("effective_to"), instant(KNOWN_PAST).alias("as_of_from"), instant(INFINITY).alias("as_of_to"),
    )
