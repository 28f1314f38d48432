"""Delta mode: split, overwrite and extend the timelines that a batch of updates touches.

Current rows and updates go into one table that is dealt out by id once; every later step is a window
over an id or a part of it, so the whole mode is one exchange and five sorts, in time n log n for
an id of n rows. Rows are lean: ids, times, hash, and all else in one struct that no step opens.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.constants import AF, AT, EF, ET, HASH
from chronolith.functions.intervals import conflate, distinct_segments, first_start, is_valid, latest_end, meets, next_start, so_far, touches, whole

EXPIRE, INSERT = "expire", "insert"


def _small(df: DataFrame) -> bool:
    """Whether Spark would send a table of this estimated size to all executors by itself."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= conf.autoBroadcastJoinThreshold()


def touched(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current rows that an update of their id can meet or touch, where the ids are few enough to be sent to all; else all.

    The others, rows of other ids and rows before or behind all updates of their id, change nothing; this only keeps
    them out of the exchange.
    """
    every = updates.select(*(F.col(k).alias(f"_of{k}") for k in keys), F.col(EF).alias("_of_from"), F.col(ET).alias("_of_to"))
    if not _small(every):
        return current
    spans = every.groupBy(*(f"_of{k}" for k in keys)).agg(F.min("_of_from").alias("_of_from"), F.max("_of_to").alias("_of_to"))
    near = (F.col(EF) <= F.col("_of_to")) & (F.col(ET) >= F.col("_of_from"))
    return current.join(spans, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys), near), "left_semi")


def roles(current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Both tables, lean, with ``_role``.

    C: a current row to expire. K: one to keep. U: an update that meets the timeline, in business time or end to end with an
    equal row it extends. N: an update by itself. Updates that say what some current row
    says already, those of no width, and the rows of ids without updates are left out.
    """
    update, inter, lone = F.col("_update"), F.col("_inter"), F.col("_update") & ~F.col("_inter")
    sides = touched(current, updates, keys).withColumn("_update", F.lit(False)), updates.withColumn("_update", F.lit(True))
    rows = sides[0].unionByName(sides[1]).where(is_valid(F.col(EF), F.col(ET)))
    by = Window.partitionBy(*keys).orderBy(EF)
    rows = rows.withColumns({"_inter": meets(~update, by), "_any": F.max("_update").over(whole(by))}).where("_any").drop("_any")
    by = Window.partitionBy(*keys, HASH).orderBy(EF)
    rows = rows.withColumns({"_known": meets(~update, by), "_beside": touches(~update, by), "_extended": touches(lone, by)})
    rows = rows.where(~(update & F.col("_known")))
    by = Window.partitionBy(*keys).orderBy(EF, *order, ET, HASH, AF)
    rows = rows.withColumn("_hit", meets(update, by))
    role = (
        F.when(update, F.when(inter | F.col("_beside"), "U").otherwise("N"))
        .when(F.col("_hit") | F.col("_extended"), "C").otherwise("K")
    )
    return rows.withColumn("_role", role).drop("_update", "_inter", "_known", "_beside", "_extended", "_hit")


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], batch: Column, end: Column) -> DataFrame:
    """Of rows with roles, what expires and what is inserted, told apart by ``_change``, in one pass."""
    role, carried = F.col("_role"), [HASH, "_row", *order]
    by = Window.partitionBy(*keys).orderBy(EF, *order, ET, HASH, AF)
    first = F.min(F.when(role == "U", F.struct(*order, EF, ET, HASH, AF))).over(whole(by))
    start = F.when(role == "U", first_start(by, role == "U")).when(role == "C", first_start(by, role == "C")).otherwise(F.col(EF))
    rows = rows.withColumns({"_first": first[AF], "_start": start}).where("_role <> 'K'")
    live = F.col("_start") < F.col(ET)
    by = Window.partitionBy(*keys).orderBy("_start")
    rows = rows.withColumns({
        "_next": next_start((role == "U") & live, by, "_start"),
        "_covered": latest_end((role == "U") & live, by),
        "_under": F.last(F.when((role == "C") & live, F.struct(ET, *carried)), ignorenulls=True).over(so_far(by)),
    })

    def row(change: str, a: Column, b: Column, known: Column, until: Column, source: str = "") -> Column:
        return F.struct(
            F.lit(change).alias("_change"), a.alias(EF), b.alias(ET), known.alias(AF), until.alias(AT), *(F.col(f"{source}{c}").alias(c) for c in carried)
        )

    # A current row leaves what lies between the updates before it and the next one; an update leaves, of the current
    # row that goes on beyond it, what lies before the next one.
    own = F.col("_start"), F.col(ET)
    left = F.greatest("_start", "_covered"), F.least(ET, "_next")
    beyond = F.col(ET), F.least(F.col(f"_under.{ET}"), F.col("_next"))
    one = F.when(role == "C", row(EXPIRE, F.col(EF), F.col(ET), F.col(AF), batch)).when(live, row(INSERT, *own, F.col(AF), end))
    two = F.when((role == "C") & live & (left[0] < left[1]), row(INSERT, *left, F.col("_first"), end)).when(
        (role == "U") & live & (F.col(f"_under.{ET}") > F.col(ET)) & (beyond[0] < beyond[1]), row(INSERT, *beyond, F.col("_first"), end, "_under.")
    )
    made = rows.select(*keys, F.inline(F.array(one, two))).where("_change is not null")
    return merged(made, keys, order)


def merged(made: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What is inserted, each range and hash once, with runs of equal rows made one; what expires as it is."""
    keys, apart = [*keys, "_change"], F.col("_change") == EXPIRE
    # without an order of its own a table is sorted once for both steps
    made = distinct_segments(made, keys, [*order, AF], apart)
    return conflate(made, keys, [HASH, "_row"], order or [HASH, AF], apart)


def expired(rows: DataFrame, batch: Column) -> DataFrame:
    return rows.where("_role = 'C'").withColumn(AT, batch).drop("_role")
