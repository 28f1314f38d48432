"""Content hashes of value columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.constants import ALGORITHMS, HASH
from chronolith.functions.jvm import WIDE, apart, double_bits, little_endian, xxh64

NULL = b"NULL"


def algorithm(name: str) -> str:
    """The plain name of a hash algorithm or of an alias, in any case of letters."""
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown hash algorithm {name!r}: use one of {', '.join(ALGORITHMS)}") from None


def _decimal(value: Column, kind: T.DecimalType) -> Column:
    """The unscaled number as 16 bytes, least first."""
    if kind.precision <= 18:
        low = F.replace(value.cast("string"), F.lit("."), F.lit("")).cast("bigint")
        return F.concat(little_endian(low), little_endian(F.when(low < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")))
    # more than 18 digits: the unscaled digits as text, taken apart by 2**64
    digits = F.replace(value.cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")
    step = F.lit(Decimal(2**64)).cast("decimal(20,0)")
    high = F.floor(digits / step).cast("decimal(20,0)")
    rest = (digits - (high * step).cast("decimal(38,0)")).cast("decimal(38,0)")
    high, rest = (F.when(rest < 0, high - 1).when(rest >= step, high + 1).otherwise(high), F.when(rest < 0, rest + step).when(rest >= step, rest - step).otherwise(rest))
    signed = F.when(rest >= F.lit(Decimal(2**63)).cast("decimal(20,0)"), rest - step).otherwise(rest)
    return F.concat(little_endian(signed.cast("bigint")), little_endian(high.cast("bigint")))


def payload_of(value: Column, kind: T.DataType, timestamp_unit: str = "us") -> Column:
    """The bytes of one value; a null is the four letters NULL."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = value.cast("string").cast("binary")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = little_endian(value.cast("bigint"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        d = value.cast("double")
        whole = (d == F.rint(d)) & (F.abs(d) < 9.2e18)
        out = little_endian(F.when(whole, d.cast("bigint")).otherwise(double_bits(d)))
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, F.lit(b"\x01")).when(~value, F.lit(b"\x00"))
    elif isinstance(kind, T.DateType):
        out = little_endian(F.unix_date(value), 4)
    elif isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
        out = little_endian(micros * (1000 if timestamp_unit == "ns" else 1))
    elif isinstance(kind, T.TimestampType):
        out = little_endian(F.unix_micros(value) * (1000 if timestamp_unit == "ns" else 1))
    elif isinstance(kind, T.DecimalType):
        out = _decimal(value, kind)
    elif isinstance(kind, T.NullType):
        return F.lit(NULL)
    else:
        raise ValueError(f"values of type {kind.simpleString()} have no hash")
    return F.coalesce(out, F.lit(NULL))


def payload(df: DataFrame, fields: Sequence[str], timestamp_unit: str = "us") -> Column:
    """The bytes of all fields on end, in their order, with nothing between."""
    if not fields:
        return F.lit(b"")
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat(*(payload_of(F.col(f"`{f}`"), kinds[f], timestamp_unit) for f in fields))


def digest(value: Column, name: str = "xxhash") -> Column:
    """Lower-case hexadecimal digits: 16 of XXH64 with seed 0, or 64 of SHA-256."""
    if algorithm(name) == "sha256":
        return F.sha2(value, 256)
    return F.lower(F.lpad(F.hex(xxh64(value)), 16, "0"))


def value_hash(df: DataFrame, fields: Sequence[str], hash_algorithm: str = "xxhash", timestamp_unit: str = "us") -> Column:
    """The hash as an expression over df, or any table whose fields have the same names and types."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    out = digest(payload(df, fields, timestamp_unit), hash_algorithm)
    return apart(out, F.col(f"`{fields[0]}`")) if len(fields) > WIDE else out


def with_value_hash(df: DataFrame, fields: Sequence[str], hash_algorithm: str = "xxhash", timestamp_unit: str = "us") -> DataFrame:
    """df with ``value_hash`` added, or replaced where it stands; no action runs."""
    return df.withColumn(HASH, value_hash(df, fields, hash_algorithm, timestamp_unit))


def add_hash_key(df: DataFrame, value_fields: Sequence[str], hash_algorithm: str = "xxhash", check_empty: bool = True) -> DataFrame:
    """:func:`with_value_hash` that refuses an empty table, which takes a small job to see."""
    out = with_value_hash(df, value_fields, hash_algorithm)
    if check_empty and df.isEmpty():
        raise ValueError("cannot add a hash to an empty table")
    return out


def has_hashes(df: DataFrame) -> bool:
    """Whether every row brings a hash of its own: then they are kept, else all are made anew."""
    if HASH not in df.columns or not isinstance(df.schema[HASH].dataType, T.StringType):
        return False
    return not df.where(F.coalesce(F.col(HASH), F.lit("")) == "").limit(1).count()
