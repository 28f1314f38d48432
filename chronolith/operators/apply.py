"""Use of change sets: storing them, and reading a table as of two instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.constants import AF, AT, EF, ET, HASH, INFINITY
from chronolith.operators.normalize import instant, temporal_types


def as_of(df: DataFrame, effective: Column, known: Column) -> DataFrame:
    """What was true at ``effective``, by what was known at ``known``; both filters reach the scan."""
    return df.where((F.col(EF) <= effective) & (F.col(ET) > effective) & (F.col(AF) <= known) & (F.col(AT) > known))


def is_live(df: DataFrame) -> Column:
    """Whether a row is what is known now: nothing has ended its time in the table."""
    return F.col(AT).isNull() | (F.col(AT) >= instant(INFINITY, temporal_types(df)[AT]))


def _unchanged(current: DataFrame, expire: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    keys = [*id_columns, EF, AF, *([HASH] if HASH in current.columns else [])]
    gone = expire.select(F.struct(*keys).alias("_key")).distinct()
    return current.withColumn("_key", F.struct(*keys)).join(gone, "_key", "left_anti").drop("_key")


def apply_changes(current: DataFrame, expire: DataFrame, insert: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """The table after a change set: rows left alone, rows expired and rows inserted.

    An expired row is found by id, start and ``as_of_from``, nulls included; its hash is compared if current has one.
    """
    names = [c for c in current.columns if c in expire.columns]
    return _unchanged(current, expire, id_columns).select(*names).unionByName(expire.select(*names)).unionByName(insert.select(*names))


def apply_change_set(current: DataFrame, changes, id_columns: Sequence[str]) -> DataFrame:
    """The same of a whole ``ChangeSet``: its rows come from one pass, and what finds the expired ones is narrow."""
    names = [c for c in current.columns if c in changes.both.columns]
    return _unchanged(current, changes.expire, id_columns).select(*names).unionByName(changes.both.select(*names))
