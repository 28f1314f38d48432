"""Predicates of half-open intervals ``[from, to)``, and windows that find what they hold for.

An id may have any number of rows, so nothing here joins the rows of an id with each other. Rows in the order of
their start know two things by one pass: the latest end of those before them, and the start of the next one.
What meets or touches a row is told by these.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from chronolith.constants import AF, AT, EF, ET, HASH, OPEN_YEAR, TEMPORAL
from chronolith.functions.jvm import next_known


def intersects(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from < b_to) & (a_to > b_from)


def adjacent(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_to == b_from) | (b_to == a_from)


def can_conflate(a_hash: Column, a_from: Column, a_to: Column, b_hash: Column, b_from: Column, b_to: Column) -> Column:
    return (a_hash == b_hash) & adjacent(a_from, a_to, b_from, b_to)


def open_ended(to: Column) -> Column:
    return F.year(to) >= OPEN_YEAR


def prevents_merge(current_to: Column, update_to: Column) -> Column:
    """A bounded current row stays apart from an open-ended update."""
    return ~open_ended(current_to) & open_ended(update_to)


def may_be_buried(effective_from: Column, midnight: Column) -> Column:
    """Whether a row that full state no longer has gets a tombstone: it began before the day."""
    return effective_from < midnight


def is_valid(effective_from: Column, effective_to: Column) -> Column:
    return effective_from < effective_to


def so_far(by: WindowSpec) -> WindowSpec:
    return by.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(by: WindowSpec) -> WindowSpec:
    return by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def latest_end(of: Column, by: WindowSpec) -> Column:
    """The latest end of the rows up to here for which ``of`` holds."""
    return F.max(F.when(of, F.col(ET))).over(so_far(by))


def next_start(of: Column, by: WindowSpec, start: str = EF) -> Column:
    """The start of the next row for which ``of`` holds."""
    return next_known(F.when(of, F.col(start))).over(by)


def meets(of: Column, by: WindowSpec) -> Column:
    """Whether a row intersects any other for which ``of`` holds; ``by`` is in the order of starts, equal ones in any."""
    return F.coalesce(latest_end(of, by) > F.col(EF), F.lit(False)) | F.coalesce(next_start(of, by) < F.col(ET), F.lit(False))


def touches(of: Column, by: WindowSpec) -> Column:
    """Whether a row that intersects none of those for which ``of`` holds is end to end with one."""
    return F.coalesce(latest_end(of, by) == F.col(EF), F.lit(False)) | F.coalesce(next_start(of, by) == F.col(ET), F.lit(False))


def conflate(df: DataFrame, keys: Sequence[str], same: Sequence[str], order: Sequence[str] = (), apart: Column | None = None) -> DataFrame:
    """Merge runs of rows of a key that touch end to start and agree on ``same`` (nulls agree).

    The first row of a run stays, with the end of its last. Rows for which ``apart`` holds start a run. All is
    told in one order of the rows: a run ends with the row before the next run's first.
    """
    by = Window.partitionBy(*keys).orderBy(EF, ET, *order)
    last, last_end = "__last", F.last(ET).over(whole(by))
    df = df.withColumns({last: F.lag(F.struct(F.col(ET), *(F.col(f"`{c}`") for c in same))).over(by), "__stop": last_end})
    joins = reduce(and_, (F.col(f"{last}.`{c}`").eqNullSafe(F.col(f"`{c}`")) for c in same), F.col(f"{last}.{ET}") == F.col(EF))
    if apart is not None:
        joins = joins & ~apart
    df = df.withColumn("__before", F.col(f"{last}.{ET}")).where(~F.coalesce(joins, F.lit(False))).drop(last)
    df = df.withColumn("__to", F.coalesce(F.lead("__before").over(by), "__stop"))
    return df.withColumn(ET, F.col("__to")).drop("__to", "__stop", "__before")


def conflate_updates(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Input conflation: runs of equal hashes."""
    return conflate(df, keys, [HASH], order)


def conflate_inserts(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), hidden: Sequence[str] = (), apart: Column | None = None) -> DataFrame:
    """Output conflation: runs that agree on every column that is not temporal."""
    return conflate(df, keys, [c for c in df.columns if c not in (*TEMPORAL, *keys, *hidden)], order, apart)


def distinct_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), apart: Column | None = None) -> DataFrame:
    """One row of each key, range and hash, the first by order; and all for which ``apart`` holds."""
    by = Window.partitionBy(*keys).orderBy(EF, ET, HASH, *(order or (AF, AT)))
    now = F.struct(EF, ET, HASH)
    again = F.lag(now).over(by).eqNullSafe(now)
    return df.withColumn("__again", again if apart is None else again & ~apart).where("not __again").drop("__again")


def elementary_segments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every two neighbouring boundaries of a key's rows, covered or not."""
    points = df.select(*keys, F.explode(F.array(EF, ET)).alias("segment_from")).distinct()
    points = points.withColumn("segment_to", F.lead("segment_from").over(Window.partitionBy(*keys).orderBy("segment_from")))
    return points.where("segment_to is not null")


def first_start(by: WindowSpec, among: Column | None = None) -> Column:
    """Where a row's own part starts, if each instant is left to the row that started first there.

    The first-started row that covers an instant is the first by order that has not ended; so a row
    holds what lies after the latest end of all rows before it, which is one piece or nothing.
    """
    ends = F.col(ET) if among is None else F.when(among, F.col(ET))
    return F.greatest(F.col(EF), F.max(ends).over(by.rowsBetween(Window.unboundedPreceding, -1)))


def first_started(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut the rows of a key so that each instant is left to the row that started first there."""
    return df.withColumn(EF, first_start(Window.partitionBy(*key).orderBy(EF, *order))).where(F.col(EF) < F.col(ET))
