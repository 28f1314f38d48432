"""What both inputs go through before changes are computed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.constants import AT, EF, ET, HASH, INFINITY, INPUT_LIMIT, OUTPUT_LIMIT, TEMPORAL
from chronolith.functions.jvm import WIDE, apart

SUPPORTED = (
    T.StringType, T.VarcharType, T.CharType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.NullType,
)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def instant(value: datetime, kind: str = "timestamp_ntz") -> Column:
    """A literal of either timestamp type; that of an aware column stands in the session's zone."""
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def validate_schema(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str]) -> bool:
    return {*id_columns, *value_columns, *TEMPORAL} <= set(df.columns)


def temporal_types(*frames: DataFrame) -> dict[str, str]:
    """For each temporal column: an instant if it is one in any table, else a naive timestamp."""
    return {c: "timestamp" if any(isinstance(d.schema[c].dataType, T.TimestampType) for d in frames if c in d.columns) else "timestamp_ntz" for c in TEMPORAL}


def normalize_temporal(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Parse the temporal columns; null and far dates become the end of time.

    A naive column beside an aware one is read in the session's zone.
    """
    kinds = kinds or temporal_types(df)
    out = {}
    for c in TEMPORAL:
        if c in df.columns:
            value = F.col(c).cast(kinds[c])
            out[c] = F.when(value.isNull() | (value >= instant(INPUT_LIMIT, kinds[c])), instant(INFINITY, kinds[c])).otherwise(value)
    return df.withColumns(out)


def restore_infinity(df: DataFrame, of: Column | None = None) -> DataFrame:
    """The end of time, in the two end columns of a result, is one instant; of the rows for which ``of`` holds, or all."""
    kinds = temporal_types(df)
    far = {c: F.col(c).isNull() | (F.col(c) >= instant(OUTPUT_LIMIT, kinds[c])) for c in (ET, AT)}
    return df.withColumns({c: F.when(f if of is None else f & of, instant(INFINITY, kinds[c])).otherwise(F.col(c)) for c, f in far.items()})


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that both sides of a column are cast to; None where they have none in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    numbers = (*_WHOLE, T.FloatType, T.DoubleType)
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, numbers) and isinstance(b, numbers):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if {type(a), type(b)} == {T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    if isinstance(a, T.StringType) and isinstance(b, T.StringType):
        return T.StringType()
    return None


def align(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the columns that both have, in the order of current, each of one type."""
    names = [c for c in current.columns if c in updates.columns]
    sides: list[list[Column]] = [[], []]
    for c in names:
        a, b = current.schema[c].dataType, updates.schema[c].dataType
        kind = common_type(a, b)
        if kind is None:
            raise ValueError(f"column {c} is {a.simpleString()} in current and {b.simpleString()} in updates")
        for side, own in zip(sides, (a, b)):
            side.append(F.col(f"`{c}`") if own == kind else F.col(f"`{c}`").cast(kind).alias(c))
    return current.select(*sides[0]), updates.select(*sides[1])


def check(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str]) -> None:
    missing = sorted({*id_columns, *value_columns, *TEMPORAL} - set(df.columns))
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    for c in (*id_columns, *value_columns):
        if not isinstance(df.schema[c].dataType, SUPPORTED):
            raise ValueError(f"column {c} has the unsupported type {df.schema[c].dataType.simpleString()}")


def lean(df: DataFrame, id_columns: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """df as the change sets take it: ids ``_k0``.., times, hash, ``_row`` with all else, ``_o`` with what input order means.

    Without ``order_by`` rows count in the order of their range and hash, which a retried task gives again.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (*id_columns, *TEMPORAL, HASH, *order_by)]
    ids = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(id_columns)]
    held = [F.struct(*(F.col(f"`{c}`") for c in order_by)).alias("_o")] if order_by else []
    return df.select(*ids, *TEMPORAL, HASH, F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_row"), *held)


def unfolded(df: DataFrame, names: Sequence[str], id_columns: Sequence[str], *more: Column | str) -> DataFrame:
    """A lean table with its columns as they were, in the order of ``names``."""
    ids = list(id_columns)
    own = [F.col(f"_k{ids.index(c)}").alias(c) if c in ids else F.col(c) if c in (*TEMPORAL, HASH) else F.col(f"_row.`{c}`").alias(c) for c in names]
    if len(names) > WIDE:
        own[names.index(EF)] = apart(F.col(EF), F.col(EF)).alias(EF)
    return df.select(*own, *more)
