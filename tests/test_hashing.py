import hashlib
import struct
from datetime import date, datetime
from decimal import Decimal

import pytest

from chronolith import add_hash_key

xxhash = pytest.importorskip("xxhash")
SCHEMA = "s string, b boolean, i int, l bigint, d double, f float, day date, t timestamp_ntz, z timestamp, p decimal(10,2), q decimal(38,3)"
EPOCH = datetime(1970, 1, 1)
ROWS = [
    ("abc", True, -5, 2**63 - 1, 150.25, 2.0, date(2020, 1, 1), datetime(1969, 12, 31, 1), datetime(2020, 1, 1), Decimal("-1.25"), Decimal("-12345678901234567890123456789012345.678")),
    ("héllo", False, 0, -(2**63), -0.0, 0.1, date(1960, 1, 1), datetime(2020, 1, 1, 1, 2, 3, 4), datetime(1960, 1, 1), Decimal("99999999.99"), Decimal("99999999999999999999999999999999999.999")),
    ("", None, None, None, float("nan"), None, None, None, None, None, Decimal("0.001")),
    (None, True, 1, 1, 1e300, 1.5, date(2000, 1, 1), EPOCH, EPOCH, Decimal("0"), Decimal("-0.001")),
]


def number(x):
    if x == x and abs(x) < 9e18 and x == int(x):
        return struct.pack("<q", int(x))
    return struct.pack("<d", x)


def payload(row):
    s, b, i, n, d, f, day, t, z, p, q = row
    micros = lambda x: struct.pack("<q", round((x - EPOCH).total_seconds() * 1e6))
    whole = lambda x, k: int(x.scaleb(k, None) if k < 3 else int(str(x).replace(".", ""))).to_bytes(16, "little", signed=True)
    parts = [
        s is not None and s.encode(), b is not None and struct.pack("<?", b), i is not None and struct.pack("<q", i),
        n is not None and struct.pack("<q", n), d is not None and number(d),
        f is not None and number(struct.unpack("f", struct.pack("f", f))[0]),
        day is not None and struct.pack("<i", (day - EPOCH.date()).days), t is not None and micros(t), z is not None and micros(z),
        p is not None and whole(p, 2), q is not None and whole(q, 3),
    ]
    return b"".join(b"NULL" if x is False else x for x in parts)


@pytest.mark.parametrize("name", ["xxhash", "XX", "sha256", "sha"])
def test_digests(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = [r.value_hash for r in add_hash_key(df, df.columns, name).collect()]
    made = (lambda x: xxhash.xxh64(x, 0).hexdigest()) if name.lower().startswith("x") else (lambda x: hashlib.sha256(x).hexdigest())
    assert out == [made(payload(r)) for r in ROWS]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "old")], "i int, s string, value_hash string")
    assert add_hash_key(df, []).first().value_hash == "ef46db3751d8e999"
    assert add_hash_key(df, ["i", "s"]).columns == df.columns
    assert add_hash_key(df, ["i", "s"]).first().value_hash != add_hash_key(df, ["s", "i"]).first().value_hash
    same = spark.sql("select 100 a, 100.0D b, cast(100 as float) c")
    assert len({add_hash_key(same, [c]).first().value_hash for c in "abc"}) == 1
    for bad in (lambda: add_hash_key(df, ["x"]), lambda: add_hash_key(df.limit(0), ["i"]), lambda: add_hash_key(df, ["i"], "md5")):
        with pytest.raises(ValueError):
            bad()


def test_nanoseconds_and_intervals(spark):
    from pyspark.sql import functions as F

    from chronolith import with_value_hash
    from chronolith.functions.intervals import adjacent, can_conflate, intersects

    t = datetime(2020, 1, 1, 1, 2, 3, 4)
    df = spark.createDataFrame([(t, t)], "t timestamp_ntz, z timestamp")
    micros = round((t - EPOCH).total_seconds() * 1e6)
    for unit, factor in (("us", 1), ("ns", 1000)):
        got = with_value_hash(df, ["t", "z"], "sha256", unit).first().value_hash
        assert got == hashlib.sha256(struct.pack("<qq", micros * factor, micros * factor)).hexdigest()
    pairs = spark.createDataFrame([(a, a + n, b, b + m, h) for a in range(4) for n in (1, 2) for b in range(4) for m in (1, 2) for h in (0, 1)], "a int, b int, c int, d int, h int")
    ends = [F.col(x) for x in "abcd"]
    for r in pairs.select("*", intersects(*ends).alias("i"), adjacent(*ends).alias("j"), can_conflate(F.col("h"), ends[0], ends[1], F.lit(1), ends[2], ends[3]).alias("k")).collect():
        assert r.i == bool(set(range(r.a, r.b)) & set(range(r.c, r.d)))
        assert r.j == (r.b == r.c or r.d == r.a) and r.k == (r.j and r.h == 1)
