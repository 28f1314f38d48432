"""A query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.constants import EF, ET, HASH
from chronolith.engine import ChangeSet, compute_changes, prepare
from chronolith.functions.hashing import with_value_hash
from chronolith.functions.intervals import can_conflate, conflate, conflate_updates, distinct_segments, elementary_segments, first_started, intersects, meets, open_ended, prevents_merge
from chronolith.operators import delta, full_state
from chronolith.operators.apply import apply_change_set, as_of
from chronolith.operators.normalize import align, instant, normalize_temporal, restore_infinity, unfolded, validate_schema
from chronolith.plans.fixtures import BATCH, IDS, KNOWN_NOW, SYSTEM_DATE, VALUES, current_state, event_runs, update_batch
from chronolith.plans.oracle import oracle_sql

Query = Callable[[SparkSession, str], DataFrame]
OUT = [*IDS, *VALUES, "effective_from", "effective_to", "as_of_from", "as_of_to"]
MIDNIGHT = f"{SYSTEM_DATE} 00:00:00"
__all__ = ["oracle_sql", "queries"]


def changes(spark: SparkSession, sf_dir: str, mode: str, **options) -> ChangeSet:
    return compute_changes(
        current_state(spark, sf_dir), update_batch(spark, sf_dir), IDS, VALUES, SYSTEM_DATE, mode,
        batch_timestamp=BATCH, order_by=["o_orderkey"], trust_hash=False, **options,
    )


def prepared(spark: SparkSession, sf_dir: str):
    return prepare(current_state(spark, sf_dir), update_batch(spark, sf_dir), IDS, VALUES, order_by=["o_orderkey"], trust_hash=False)


def normalize_infinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_state(spark, sf_dir).withColumns({
        "effective_to": F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).when(F.col("o_custkey") % 3 == 1, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).otherwise(F.col("effective_to")),
        "as_of_to": F.lit("2262-04-11 00:00:00"),
    })
    return restore_infinity(normalize_temporal(rows)).select(*OUT)


def validate_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides, with the columns that both have, in one order."""
    current, updates = current_state(spark, sf_dir).withColumn("note", F.lit("x")), update_batch(spark, sf_dir)
    sides = align(current, updates.select(*reversed(updates.columns)))
    return sides[0].withColumn("side", F.lit("current")).union(sides[1].withColumn("side", F.lit("updates")))


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the current state is a valid input without each of its columns."""
    current = current_state(spark, sf_dir).withColumn("note", F.lit("x"))
    rows = [(c, validate_schema(current.drop(c), IDS, VALUES)) for c in current.columns]
    return spark.createDataFrame(rows, "without string, valid boolean")


def hash_values(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 2 == 0).alias("even"))
        return with_value_hash(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "even"], name)

    return run


def hash_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and broken doubles, a date, a timestamp, a decimal, an int with nulls, and nothing but null."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("day"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"),
        F.col("l_tax").cast("decimal(10,2)").alias("tax"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("line"), F.lit(None).alias("none"),
    )
    return with_value_hash(rows, ["l_quantity", "l_extendedprice", "day", "at", "tax", "line", "none"], "sha256").select("l_orderkey", "l_linenumber", HASH)


def plain(df: DataFrame, got, *more) -> DataFrame:
    return unfolded(df, [c for c in got.names if c in OUT], IDS, *more)


def categorize_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prepared(spark, sf_dir)
    rows = delta.roles(got.current, got.updates, got.keys, got.order).where("_role in ('U', 'N')")
    return plain(rows, got, F.when(F.col("_role") == "U", "overlapping").otherwise("alone").alias("category"))


def affected_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prepared(spark, sf_dir)
    return plain(delta.roles(got.current, got.updates, got.keys, got.order).where("_role = 'C'"), got)


def no_change_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prepared(spark, sf_dir)
    both = got.current.withColumn("u", F.lit(False)).unionByName(got.updates.withColumn("u", F.lit(True)))
    by = Window.partitionBy(*got.keys, HASH).orderBy(EF)
    return plain(both.withColumn("known", F.col("u") & meets(~F.col("u"), by)).where("known"), got)


def pairs(touching: bool) -> Query:
    """Neighbours of a timeline, by windows; the input's own rows do not overlap."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        updates = update_batch(spark, sf_dir)
        if touching:
            rows = event_runs(spark, sf_dir)
            by = Window.partitionBy("user_id", "event_type", "bucket").orderBy(EF)
            rows = rows.withColumns({"next_from": F.lead(EF).over(by), "next_to": F.lead(ET).over(by)})
            same = F.col("bucket"), F.col(EF), F.col(ET), F.col("bucket"), F.col("next_from"), F.col("next_to")
            return rows.where(can_conflate(*same)).select("user_id", "event_type", "bucket", EF, "next_from")
        # a range of times is cut into days' bins, so that the join is on keys and not on all of an id
        day = lambda c: F.unix_date(F.col(c).cast("date"))
        bins = F.explode(F.sequence(F.floor(day(EF) / 60), F.floor((day(ET) - 1) / 60)))
        left = updates.select("o_custkey", F.col("o_orderkey").alias("first_key"), F.col(EF).alias("f1"), F.col(ET).alias("t1")).withColumn("bin", F.explode(F.sequence(F.floor(day("f1") / 60), F.floor((day("t1") - 1) / 60))))
        right = updates.select("o_custkey", F.col("o_orderkey").alias("second_key"), EF, ET).withColumn("bin", bins)
        met = left.join(right, ["o_custkey", "bin"]).where((F.col("first_key") < F.col("second_key")) & intersects(F.col("f1"), F.col("t1"), F.col(EF), F.col(ET)))
        # a pair is told in the bin where its overlap starts
        met = met.where(F.col("bin") == F.floor(F.unix_date(F.greatest("f1", EF).cast("date")) / 60))
        return met.select("o_custkey", "first_key", "second_key")

    return run


def elementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = current_state(spark, sf_dir).select("o_custkey", EF, ET).union(update_batch(spark, sf_dir).select("o_custkey", EF, ET))
    return elementary_segments(both, ["o_custkey"])


def segment_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_started(update_batch(spark, sf_dir), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", EF, ET)


def conflate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_value_hash(event_runs(spark, sf_dir), ["bucket"])
    return conflate_updates(rows, ["user_id", "event_type"]).drop(HASH)


def conflate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflate(event_runs(spark, sf_dir), ["user_id"], ["event_type", "bucket"], ["event_type"])


def dedup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_runs(spark, sf_dir)
    return distinct_segments(with_value_hash(rows.union(rows), ["bucket"]), ["user_id", "event_type"]).drop(HASH)


def open_ended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_state(spark, sf_dir)
    return rows.select("o_custkey", EF, open_ended(F.col(ET)).alias("is_open"), prevents_merge(F.col(ET), F.lit("2260-12-31 23:59:59").cast("timestamp_ntz")).alias("stays_apart"))


def full_state_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prepared(spark, sf_dir)
    return full_state.classified(got.current, got.updates, got.keys, got.order).where("_update").groupBy(F.col("_case").alias("case")).agg(F.count("*").alias("n"))


def full_state_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prepared(spark, sf_dir)
    rows = full_state.classified(got.current, got.updates, got.keys, got.order).withColumn("_stamp", instant(KNOWN_NOW))
    return plain(full_state.tombstones(rows, F.lit(MIDNIGHT).cast("timestamp_ntz")), got)


def part_of(mode: str, part: str, conflated: bool = False) -> Query:
    return lambda spark, sf_dir: getattr(changes(spark, sf_dir, mode, conflate_inputs=conflated), part).select(*OUT)


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_change_set(current_state(spark, sf_dir), changes(spark, sf_dir, "delta"), IDS).select(*OUT)


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(applied(spark, sf_dir), F.lit("1996-06-01").cast("timestamp_ntz"), instant(BATCH)).select(*OUT)


def queries() -> dict[str, Query]:
    return {
        "normalize_infinity": normalize_infinity, "validate_and_align": validate_and_align, "schema_checks": schema_checks,
        "hash_sha256_values": hash_values("sha256"), "hash_xxh64_values": hash_values("xxhash"), "hash_typed_values": hash_typed_values,
        "no_change_updates": no_change_updates, "overlap_pairs": pairs(False), "adjacent_pairs": pairs(True),
        "affected_current": affected_current, "categorize_updates": categorize_updates,
        "elementary_segments": elementary, "segment_winner": segment_winner,
        "conflate_inputs": conflate_inputs, "conflate_outputs": conflate_outputs, "dedup_segments": dedup_segments,
        "open_ended_rows": open_ended_rows,
        "delta_expire": part_of("delta", "expire"), "delta_insert": part_of("delta", "insert"),
        "delta_conflated": part_of("delta", "insert", True),
        "full_state_expire": part_of("full_state", "expire"), "full_state_insert": part_of("full_state", "insert"),
        "full_state_conflated": part_of("full_state", "insert", True),
        "full_state_tombstones": full_state_tombstones, "full_state_case_counts": full_state_case_counts,
        "apply_changeset": applied, "as_of_snapshot": as_of_snapshot,
    }
