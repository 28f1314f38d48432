"""Catalyst expressions that have no SQL name, by the JVM gateway of a classic session."""

from __future__ import annotations

from functools import lru_cache
from types import SimpleNamespace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Columns beyond which a projection is kept out of whole-stage code.
WIDE = 16


def active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


@lru_cache(maxsize=4)
def _names(jvm) -> SimpleNamespace:
    """The classes in use; every step of a dotted name is a call of the gateway, so they are looked up once."""
    catalyst, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types.DataTypes
    return SimpleNamespace(
        utils=jvm.org.apache.spark.sql.classic.ExpressionUtils, cast=catalyst.Cast, xxhash=catalyst.XxHash64, invoke=catalyst.objects.StaticInvoke,
        legacy=getattr(getattr(catalyst, "EvalMode$"), "MODULE$").LEGACY(), none=jvm.scala.Option.empty(), seq=jvm.PythonUtils.toSeq,
        long=types.LongType, int=types.IntegerType, binary=types.BinaryType, lead=jvm.org.apache.spark.sql.functions.lead,
        owners={name: jvm.java.lang.Class.forName(f"java.lang.{name}") for name in ("Long", "Integer", "Double")},
    )


def _here() -> SimpleNamespace:
    return _names(active()._jvm)


def _static(names: SimpleNamespace, owner: str, kind, method: str, argument):
    """A call of a static Java method, null where its argument is null."""
    return names.invoke(names.owners[owner], kind, method, names.seq([argument]), names.seq([]), True, True, True, names.none)


def xxh64(payload: Column) -> Column:
    """XXH64 with seed 0 of a binary column, as a signed long (the SQL function has seed 42)."""
    names = _here()
    return Column(names.utils.column(names.xxhash(names.seq([names.utils.expression(payload._jc)]), 0)))


def double_bits(value: Column) -> Column:
    """The IEEE 754 bits of a double, as a signed long."""
    names = _here()
    return Column(names.utils.column(_static(names, "Double", names.long, "doubleToRawLongBits", names.utils.expression(value._jc))))


def little_endian(value: Column, size: int = 8) -> Column:
    """The bytes of a long (8) or an int (4), least first: its bytes turned round, then as binary."""
    names = _here()
    owner, kind = ("Long", names.long) if size == 8 else ("Integer", names.int)
    turned = _static(names, owner, kind, "reverseBytes", names.utils.expression(value._jc))
    return Column(names.utils.column(names.cast(turned, names.binary, names.none, names.legacy)))


def next_known(value: Column) -> Column:
    """For use over a window: the value of the next row that has one, nulls passed over."""
    return Column(_here().lead(value._jc, 1, None, True))


def apart(value: Column, any_column: Column) -> Column:
    """The same value, in a projection kept out of whole-stage code.

    There the code of many columns is one method too long for the JVM to compile, which then runs it step by step, ten times
    slower. Beside a function of lambdas Spark makes a projection of its own, cut into short methods.
    """
    return F.when(F.size(F.transform(F.array(any_column), lambda x: x)) > 0, value)
