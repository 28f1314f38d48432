"""Full-state mode: updates are all there is; what they lack gets a tombstone.

As in delta mode both tables are dealt out by id once and all else is windows. The match of an update among
the current rows with its hash is the row with its very range, else the last row that touches it, else
the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.constants import AF, AT, EF, ET, HASH
from chronolith.functions.intervals import may_be_buried, prevents_merge
from chronolith.operators.delta import EXPIRE, INSERT, merged


def classified(current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Both tables, lean, with what full state makes of each row.

    ``_case`` of updates: 1a touches an equal row but stays apart, 1b merges with it, 2 is it, 3a lies within it,
    3b starts with it and ends later, 3c is elsewhere, 4 has no equal row. ``_match``: (order, range)
    of that row. ``_expire`` of current rows; ``_absent``: no update has the id.
    """
    rows = current.withColumn("_update", F.lit(False)).unionByName(updates.withColumn("_update", F.lit(True)))
    update = F.col("_update")
    over = lambda *key: Window.partitionBy(*keys, *key)
    rows = rows.withColumn("_ord", F.struct(*order, EF, ET))
    own = F.when(~update, F.col("_ord"))
    # the longest key first, so that the next window finds its rows in order
    rows = rows.withColumn("_exact", F.min(own).over(over(HASH, EF, ET))).withColumn("_first", F.min(own).over(over(HASH)))
    rows = rows.withColumn("_at", F.when(update, F.col(EF)).otherwise(F.col(ET))).withColumn("_left", F.max(own).over(over(HASH, "_at")))
    rows = rows.withColumn("_at", F.when(update, F.col(ET)).otherwise(F.col(EF))).withColumn("_right", F.max(own).over(over(HASH, "_at")))
    beside = F.greatest("_left", "_right")
    rows = rows.withColumn("_beside", beside).withColumn("_match", F.when(update, F.coalesce("_exact", beside, "_first")))
    start, stop = F.col(f"_match.{EF}"), F.col(f"_match.{ET}")
    case = (
        F.when(~update, None).when(F.col("_match").isNull(), "4").when(F.col("_exact").isNotNull(), "2")
        .when(F.col("_beside").isNotNull(), F.when(prevents_merge(stop, F.col(ET)), "1a").otherwise("1b"))
        .when((start <= F.col(EF)) & (stop >= F.col(ET)), "3a")
        .when((start == F.col(EF)) & (F.col(ET) > stop), "3b").otherwise("3c")
    )
    rows = rows.withColumn("_case", case).withColumn("_at", F.when(update, F.col("_match")).otherwise(F.col("_ord")))
    rows = rows.withColumn("_met", F.max(F.when(F.col("_case").isin("1b", "3b"), 1)).over(over(HASH, "_at")))
    rows = rows.withColumn("_until", F.max(F.when(update, F.struct("_ord", HASH, ET))).over(over(EF))[ET])
    queued = F.min(F.when(F.col("_case").isin("1a", "3b", "3c", "4"), F.struct("_ord", HASH, "_case"))).over(over())
    rows = rows.withColumns({"_queued": queued["_case"], "_absent": ~F.max("_update").over(over())})
    rows = rows.withColumn("_expire", ~update & (F.coalesce(F.col("_queued") == "4", F.lit(False)) | (F.coalesce(F.col("_met"), F.lit(0)) == 1)))
    return rows.drop("_exact", "_first", "_left", "_right", "_beside", "_at", "_met", "_queued", "_ord")


WORKING = ("_update", "_absent", "_match", "_case", "_expire", "_until", "_stamp")


def buried(midnight: Column, strict: bool) -> Column:
    out = ~F.col("_update") & F.col("_absent") & may_be_buried(F.col(EF), midnight)
    return out & (F.col(ET) > midnight) if strict else out


def _gone(midnight: Column, strict: bool) -> Column:
    return F.col("_expire") | buried(midnight, strict)


def expired(rows: DataFrame, midnight: Column, batch: Column, strict: bool = False) -> DataFrame:
    """Rows replaced, with the end that their successor has, and rows that get a tombstone."""
    return rows.where(_gone(midnight, strict)).withColumn(ET, F.coalesce("_until", ET)).withColumn(AT, batch).drop(*WORKING)


def tombstones(rows: DataFrame, midnight: Column, strict: bool = False) -> DataFrame:
    return rows.where(buried(midnight, strict)).withColumn(ET, midnight).withColumn(AF, F.col("_stamp")).drop(*WORKING)


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], midnight: Column, batch: Column, strict: bool = False) -> DataFrame:
    """What expires and what is inserted, told apart by ``_change``: updates that change something, merged rows and tombstones."""
    carried, merges = [HASH, "_row", *order], F.coalesce(F.col("_case") == "1b", F.lit(False))

    def row(change: str, a: Column, b: Column, known: Column, until: Column) -> Column:
        return F.struct(F.lit(change).alias("_change"), a.alias(EF), b.alias(ET), known.alias(AF), until.alias(AT), *carried)

    own = [F.col(c) for c in (EF, ET, AF, AT)]
    joined = F.least(EF, f"_match.{EF}"), F.greatest(ET, f"_match.{ET}")
    one = F.when(_gone(midnight, strict), row(EXPIRE, own[0], F.coalesce("_until", ET), own[2], batch))
    two = (
        F.when(buried(midnight, strict), row(INSERT, own[0], midnight, F.col("_stamp"), own[3]))
        .when(merges, row(INSERT, *joined, F.col("_stamp"), own[3]))
        .when(F.col("_case").isin("1a", "3b", "3c", "4"), row(INSERT, *own))
    )
    made = rows.select(*keys, F.inline(F.array(one, two))).where("_change is not null")
    return merged(made, keys, order)
