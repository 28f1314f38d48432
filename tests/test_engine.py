"""Change sets against a plain model on random timelines, and against worked examples."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from chronolith import BitemporalProcessor, apply_changes, as_of, compute_changes
from chronolith.constants import INFINITY
from tests import model

DAY0 = datetime(1970, 1, 1)
SCHEMA = "id int, field string, value int, effective_from timestamp_ntz, effective_to timestamp_ntz, as_of_from timestamp_ntz, as_of_to timestamp_ntz"
STAMP = datetime(2024, 5, 5)


def at(day):
    return INFINITY if day >= model.END else DAY0 + timedelta(days=day)


def day(t):
    return model.END if t == INFINITY else (t - DAY0).days


def table(spark, rows):
    return spark.createDataFrame([(i, "f", r["value"], at(r["from"]), at(r["to"]), at(r["as_of"]), INFINITY) for i, r in rows], SCHEMA)


def got(df):
    return sorted((r.id, r.value, day(r.effective_from), day(r.effective_to), day(r.as_of_from)) for r in df.collect())


def want(rows):
    return sorted((i, r["value"], r["from"], r["to"], r["as_of"]) for i, r in rows)


def timelines(seed, ids=400):
    rng = random.Random(seed)
    current, updates = [], []
    for i in range(ids):
        t = rng.randint(0, 6)
        for _ in range(rng.randint(0, 4)):
            length = rng.randint(1, 6)
            end = model.END if rng.random() < 0.15 else t + length
            current.append((i, {"value": rng.randint(0, 2), "from": t, "to": end, "as_of": 100 + rng.randint(0, 3)}))
            if end == model.END:
                break
            t = end + rng.choice((0, 0, 1, 3))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 20)
            b = model.END if rng.random() < 0.2 else a + rng.randint(0, 8)
            updates.append((i, {"value": rng.randint(0, 2), "from": a, "to": b, "as_of": 200 + rng.randint(0, 3)}))
    return current, updates


def by_id(rows):
    out = {}
    for i, r in rows:
        out.setdefault(i, []).append(r)
    return out


def distinct(rows):
    """Rows of one id, range and value more than once have no order among them: keep one."""
    return list({(i, model.order(r)): (i, r) for i, r in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_delta_model(spark, seed):
    current, updates = map(distinct, timelines(seed))
    expire, insert = compute_changes(table(spark, current), table(spark, updates), ["id", "field"], ["value"], batch_timestamp=STAMP)
    c, u = by_id(current), by_id(updates)
    made = {i: model.delta(c.get(i, []), u[i]) for i in u}
    assert got(insert) == want((i, r) for i, (_, ins) in made.items() for r in ins)
    assert got(expire) == want((i, r) for i, (ex, _) in made.items() for r in ex)
    assert {r.as_of_to for r in expire.select("as_of_to").distinct().collect()} == {STAMP}
    # what is stored afterwards has one row for each instant, and the same updates change nothing
    if seed == 1:
        after = apply_changes(table(spark, current), expire, insert, ["id", "field"]).where("as_of_to > '2200-01-01'")
        again = compute_changes(after.where("id < 0").union(after), table(spark, updates).limit(0), ["id", "field"], ["value"])
        assert again.insert.isEmpty() and again.expire.isEmpty()


@pytest.mark.parametrize("seed", [3, 4])
def test_full_state_model(spark, seed):
    current, updates = map(distinct, timelines(seed))
    updates = [(i, r) for i, r in updates if r["from"] < r["to"]]
    expire, insert = compute_changes(
        table(spark, current), table(spark, updates), ["id", "field"], ["value"], "1970-01-11", "full_state", batch_timestamp=STAMP, hash_algorithm="sha256", order_by=["effective_from", "effective_to", "value"],
    )
    c, u = by_id(current), by_id(updates)
    stamp = min(updates, key=lambda x: model.order(x[1]))[1]["as_of"]
    made = {i: model.full_state(c.get(i, []), u.get(i, []), 10, stamp) for i in {*c, *u}}
    ties = [r for r in updates if model.order(r[1]) == min(model.order(x[1]) for x in updates)]
    if len({r["as_of"] for _, r in ties}) == 1:
        assert got(insert) == want((i, r) for i, (_, ins) in made.items() for r in ins)
    assert got(expire) == want((i, r) for i, (ex, _) in made.items() for r in ex)


P, N = 20000, 20001
#: Days of the examples, in order.
A, B, C, D, F_ = 19000, 19017, 19050, 19111, 19300
END = model.END


def r(value, start, end, known):
    return {"value": value, "from": start, "to": end, "as_of": known}


#: name: current, updates, expired, inserted
CASES = {
    "nothing there": ([], [r(7, A, B, N), r(8, B, C, N)], [], [r(7, A, B, N), r(8, B, C, N)]),
    "other value": ([r(7, A, C, P)], [r(8, A, C, N)], [r(7, A, C, P)], [r(8, A, C, N)]),
    "apart": ([r(7, A, B, P)], [r(7, D, END, N)], [], [r(7, D, END, N)]),
    "end cut off": ([r(7, A, END, P)], [r(9, D, END, N)], [r(7, A, END, P)], [r(7, A, D, N), r(9, D, END, N)]),
    "start cut off": ([r(7, B, END, P)], [r(9, A, D, N)], [r(7, B, END, P)], [r(9, A, D, N), r(7, D, END, N)]),
    "hole": ([r(7, A, END, P)], [r(9, C, D, N)], [r(7, A, END, P)], [r(7, A, C, N), r(9, C, D, N), r(7, D, END, N)]),
    "two holes": ([r(7, A, END, P)], [r(9, B, C, N), r(8, D, F_, N)], [r(7, A, END, P)], [r(7, A, B, N), r(9, B, C, N), r(7, C, D, N), r(8, D, F_, N), r(7, F_, END, N)]),
    "end to end before": ([r(7, B, C, P)], [r(9, A, B, N)], [], [r(9, A, B, N)]),
    "end to end behind": ([r(7, A, B, P)], [r(9, B, C, N)], [], [r(9, B, C, N)]),
    "said already": ([r(7, A, END, P)], [r(7, B, C, N)], [], []),
    "longer": ([r(7, A, B, P)], [r(7, B, C, N)], [r(7, A, B, P)], [r(7, A, C, N)]),
    "longer before": ([r(7, B, C, P)], [r(7, A, B, N)], [r(7, B, C, P)], [r(7, A, C, N)]),
    "several": ([r(1, A, B, P), r(2, B, C, P), r(3, C, END, P)], [r(9, B - 3, D, N)], [r(1, A, B, P), r(2, B, C, P), r(3, C, END, P)], [r(1, A, B - 3, N), r(9, B - 3, D, N), r(3, D, END, N)]),
    # a row corrected to its neighbour's value leaves the neighbour alone
    "like its neighbour": ([r(1, A, B, P), r(2, B, C, P), r(3, C, D, P)], [r(1, B, C, N)], [r(2, B, C, P)], [r(1, B, C, N)]),
    "no width": ([r(7, A, B, P)], [r(9, A, A, N)], [], []),
}
#: The same for full state, on a day between C and D.
DAY = C + 20
FULL = {
    "new value": ([r(7, A, B, P)], [r(8, A, B, N)], [r(7, A, B, P)], [r(8, A, B, N)]),
    "the same": ([r(7, A, B, P)], [r(7, A, B, N)], [], []),
    "no longer there": ([r(7, A, END, P)], [], [r(7, A, END, P)], [r(7, A, DAY, N)]),
    "not yet there": ([r(7, D, END, P)], [], [], []),
    "partly": ([r(7, A, C, P), r(8, D, END, P)], [], [r(7, A, C, P)], [r(7, A, DAY, N)]),
    "new value, other end": ([r(7, A, END, P)], [r(8, A, B, N)], [r(7, A, B, P)], [r(8, A, B, N)]),
    "within": ([r(7, A, END, P)], [r(7, B, C, N)], [], []),
    "longer": ([r(7, A, B, P)], [r(7, B, C, N)], [r(7, A, B, P)], [r(7, A, C, N)]),
    "bounded, then open": ([r(7, A, B, P)], [r(7, B, END, N)], [], [r(7, B, END, N)]),
    "later end": ([r(7, A, B, P)], [r(7, A, D, N)], [r(7, A, D, P)], [r(7, A, D, N)]),
    "its very range before a neighbour": ([r(7, A, B, P), r(7, B, C, P)], [r(7, B, C, N)], [], []),
    "end to end updates": ([], [r(7, A, B, N), r(7, B, C, N)], [], [r(7, A, C, N)]),
}


def parts(cases):
    return [[(i, row) for i, name in enumerate(cases) for row in cases[name][k]] for k in range(4)]


def test_delta_examples(spark):
    current, updates, expired, inserted = parts(CASES)
    out = BitemporalProcessor(["id", "field"], ["value"]).compute_changes(table(spark, current), table(spark, updates), batch_timestamp=STAMP)
    assert got(out.expire) == want(expired)
    assert got(out.insert) == want(inserted)
    for change, rows in (("expire", expired), ("insert", inserted)):
        assert got(out.both.where(f"change = '{change}'")) == want(rows)
    alone, *_ = [compute_changes(table(spark, []), table(spark, updates), ["id"], ["value"])]
    assert got(alone.insert) == want(updates) and alone.expire.isEmpty()  # no current rows: updates as they come


def test_full_state_examples(spark):
    current, updates, expired, inserted = parts(FULL)
    out = BitemporalProcessor(["id", "field"], ["value"]).compute_changes(
        table(spark, current), table(spark, updates), (DAY0 + timedelta(days=DAY)).date(), "full_state", batch_timestamp=STAMP,
    )
    assert got(out.expire) == want(expired)
    assert got(out.insert) == want(inserted)
    assert got(out.both.where("change = 'insert'")) == want(inserted) and got(out.both.where("change = 'expire'")) == want(expired)


def test_conflated_inputs_and_empty_sides(spark):
    rows = [(1, r(3, A, B, N)), (1, r(3, B, C, P)), (1, r(4, C, END, N)), (2, r(3, C, END, N))]
    none = table(spark, rows).limit(0)
    out = compute_changes(none, table(spark, rows), ["id", "field"], ["value"], update_mode="full_state", conflate_inputs=True)
    assert got(out.insert) == want([(1, r(3, A, C, N)), (1, r(4, C, END, N)), (2, r(3, C, END, N))])
    assert out.expire.isEmpty()
    day_ = DAY0 + timedelta(days=B + 5)
    gone = compute_changes(table(spark, rows), none, ["id", "field"], ["value"], str(day_.date()), "full_state", batch_timestamp=STAMP)
    # both rows of id 1 that began get a tombstone to the day; the later ones are left alone
    assert [x[:4] for x in got(gone.insert)] == [(1, 3, A, B + 5), (1, 3, B, B + 5)]
    assert got(gone.expire) == want(rows[:2])
    # strict: a row that had ended by then gets none
    strict = compute_changes(table(spark, rows), none, ["id", "field"], ["value"], day_.date(), "full_state", batch_timestamp=STAMP, strict=True)
    assert [x[:4] for x in got(strict.insert)] == [(1, 3, B, B + 5)] and got(strict.expire) == want(rows[1:2])
    both = compute_changes(none, none, ["id"], ["value"], look=True)
    assert both.insert.isEmpty() and both.expire.isEmpty() and "change" in both.both.columns
    # without the look both are taken to have rows, and have the same changes where that is so
    some = [compute_changes(table(spark, rows[:2]), table(spark, rows[2:3]), ["id", "field"], ["value"], batch_timestamp=STAMP, look=x) for x in (True, False)]
    assert got(some[0].insert) == got(some[1].insert) and got(some[0].expire) == got(some[1].expire)


def test_errors_nulls_and_types(spark):
    df = table(spark, [(1, r(3, A, END, P))])
    with pytest.raises(ValueError):
        compute_changes(df, df, ["id", "field"], ["value"], update_mode="merge")
    with pytest.raises(ValueError):
        compute_changes(df, df, ["id", "missing"], ["value"])
    with pytest.raises(ValueError):
        compute_changes(df, df, ["id"], ["value"], system_date="2020-13-01")
    # a null value becomes one; ids null on both sides are one id; ints and doubles of one number are equal
    a = spark.sql("select cast(null as int) id, 'f' field, 100 value, timestamp_ntz'2020-01-01' effective_from, cast(null as timestamp_ntz) effective_to, timestamp_ntz'2020-01-01' as_of_from, timestamp_ntz'9999-12-31' as_of_to, 7 extra")
    b = a.selectExpr("id", "field", "cast(value as double) value", "effective_from", "effective_to", "as_of_from", "as_of_to")
    same = compute_changes(a, b, ["id", "field"], ["value"])
    assert same.insert.isEmpty() and same.expire.isEmpty() and "extra" not in same.insert.columns
    other = compute_changes(a.withColumn("value", F.lit(None)), b, ["id", "field"], ["value"])
    assert [(x.value, x.effective_to) for x in other.insert.collect()] == [(100.0, INFINITY)]
    aware = b.selectExpr("id", "field", "value", "cast(effective_from as timestamp) effective_from", "effective_to", "as_of_from", "as_of_to")
    assert compute_changes(a, aware, ["id", "field"], ["value"]).insert.isEmpty()


def test_as_of(spark):
    df = table(spark, [(1, r(3, A, B, P)), (1, r(4, B, END, P))])
    now = F.lit(str(at(C))).cast("timestamp_ntz")
    assert got(as_of(df, now, F.lit("2200-01-01").cast("timestamp_ntz"))) == want([(1, r(4, B, END, P))])


def test_shuffled_and_broadcast_ids_agree(spark):
    """The ids of few updates are sent to all, those of many are not: both paths give the same."""
    current, updates = map(distinct, timelines(9, 150))
    sides = table(spark, current), table(spark, updates)
    out = {}
    try:
        for limit in ("10MB", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            changes = compute_changes(*sides, ["id", "field"], ["value"], batch_timestamp=STAMP)
            out[limit] = got(changes.expire), got(changes.insert), got(changes.both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out["10MB"] == out["-1"] and out["-1"][0] and out["-1"][1]


WIDE = 90


def test_many_columns_of_many_types(spark):
    """More columns than whole-stage code takes; their order, types and nulls come through, and one that changes is seen."""
    kinds = ("cast(id * 1.5 as double)", "id", "cast(id as string)", "cast(null as int)", "id % 2 = 0", "date_add(date'2020-01-01', cast(id as int))", "cast(id as decimal(20,3))", "cast(id as float)")
    values = [f"{kinds[i % len(kinds)]} v{i}" for i in range(WIDE)]
    times = "timestamp_ntz'2020-01-01' effective_from, timestamp_ntz'2260-12-31 23:59:59' effective_to, timestamp_ntz'2020-01-01' as_of_from, timestamp_ntz'2260-12-31 23:59:59' as_of_to"
    current = spark.range(40).selectExpr("id", *values, times.split(", ")[0], *times.split(", ")[1:], "array(id) other")
    changed = [v if i != 33 else "id + id % 2 v33" for i, v in enumerate(values)]
    updates = spark.range(40).selectExpr("array(id) other", "id", *reversed(changed), *times.replace("from, timestamp_ntz'2260", "from, timestamp_ntz'2260").split(", "))
    out = compute_changes(current, updates, ["id"], [f"v{i}" for i in range(WIDE)], batch_timestamp=STAMP)
    assert {x.id for x in out.insert.collect()} == set(range(1, 40, 2)) == {x.id for x in out.expire.collect()}
    assert [c for c in out.insert.columns if c != "value_hash"] == [c for c in current.columns if c != "value_hash"]
    assert out.insert.schema["v6"].dataType == current.schema["v6"].dataType
    assert out.both.where("change = 'insert'").select("v33").agg(F.min(F.col("v33") % 2)).first()[0] == 0


def test_brought_hashes(spark):
    """Hashes that every row brings are kept and compared as they are; else all are made anew."""
    row = lambda i, value, h, start, end: (i, value, h, at(start), at(end), at(P), INFINITY)
    schema = "id int, value string, value_hash string, effective_from timestamp_ntz, effective_to timestamp_ntz, as_of_from timestamp_ntz, as_of_to timestamp_ntz"
    current = [row(1, "a", "x1", A, END), row(2, "b", "x2", A, B), row(3, "c", "x3", A, B)]
    same = [row(1, "a", "x1", A, B), row(2, "b", "x2", A, B), row(3, "other", "x3", A, B)]
    make = lambda rows: spark.createDataFrame(rows, schema)
    for mode in ("delta", "full_state"):
        out = compute_changes(make(current), make(same), ["id"], ["value"], update_mode=mode)
        assert out.insert.isEmpty() and out.expire.isEmpty()
        assert {x.id for x in compute_changes(make(current), make(same), ["id"], ["value"], update_mode=mode, trust_hash=False).insert.collect()} == {3}
    # one missing hash: that side is hashed anew, and nothing matches what was brought
    partly = [*same[:2], (*same[2][:2], None, *same[2][3:])]
    assert {x.id for x in compute_changes(make(current), make(partly), ["id"], ["value"]).insert.collect()} == {1, 2, 3}
    trusted = compute_changes(make(current), make(partly), ["id"], ["value"], trust_hash=True)
    assert {x.id for x in trusted.insert.collect()} == {3}


def test_zones_and_text_dates(spark):
    """Instants, naive times, dates and texts of one moment are one; a zone's results are instants."""
    base = "1 id, 5 value, {} effective_from, {} effective_to, timestamp_ntz'2020-01-01' as_of_from, timestamp_ntz'9999-12-31' as_of_to"
    ways = {
        "naive": ("timestamp_ntz'2020-03-01'", "timestamp_ntz'2020-09-01'"), "date": ("date'2020-03-01'", "date'2020-09-01'"),
        "text": ("'2020-03-01 00:00:00'", "'2020-09-01'"), "instant": ("timestamp'2020-03-01 01:00:00+01:00'", "timestamp'2020-08-31 19:00:00-05:00'"),
    }
    made = {k: spark.sql("select " + base.format(*v)) for k, v in ways.items()}
    for a in made.values():
        for b in made.values():
            out = compute_changes(a, b, ["id"], ["value"], update_mode="full_state")
            assert out.insert.isEmpty() and out.expire.isEmpty()
    later = spark.sql("select " + base.format("timestamp'2020-03-01 00:00:00+00:00'", "timestamp'2021-01-01 00:00:00+00:00'").replace("5 value", "6 value"))
    out = compute_changes(made["instant"], later, ["id"], ["value"], batch_timestamp=STAMP)
    assert out.insert.schema["effective_from"].dataType.simpleString() == "timestamp" and out.insert.count() == 1
    assert [x.effective_to for x in out.insert.selectExpr("cast(effective_to as timestamp_ntz) effective_to").collect()] == [datetime(2021, 1, 1)]
    # the same in another zone of the session
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = compute_changes(made["instant"], later, ["id"], ["value"], batch_timestamp=STAMP)
        assert out.insert.where("effective_to = timestamp'2021-01-01 00:00:00+00:00'").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_columns_of_one_side_and_void_ones(spark):
    times = "timestamp_ntz'2020-01-01' effective_from, timestamp_ntz'9999-12-31' effective_to, timestamp_ntz'2020-01-01' as_of_from, cast(null as timestamp_ntz) as_of_to"
    current = spark.sql(f"select 1 id, null note, true flag, 'a' name, 9 mine, {times}")
    updates = spark.sql(f"select 'a' name, 7 yours, false flag, cast(null as string) note, 1 id, {times}")
    out = compute_changes(current, updates, ["id"], ["note", "flag", "name"], batch_timestamp=STAMP)
    row = out.insert.first()
    assert set(out.insert.columns) == {"id", "note", "flag", "name", "effective_from", "effective_to", "as_of_from", "as_of_to", "value_hash"}
    assert (row.flag, row.name, row.note, row.effective_to, row.as_of_to) == (False, "a", None, INFINITY, INFINITY)
    assert out.expire.first().as_of_to == STAMP and out.expire.first().flag is True
    same = compute_changes(current, current, ["id"], ["note", "flag", "name"])
    assert same.insert.isEmpty() and same.expire.isEmpty()


def test_order_by_decides_ties(spark):
    """Of updates that start together the first in input order holds its time."""
    rows = [(1, "f", 5, at(A), at(C), at(N), INFINITY, 2), (1, "f", 6, at(A), at(B), at(N), INFINITY, 1)]
    updates = spark.createDataFrame(rows, SCHEMA + ", n int")
    current = table(spark, [(1, r(3, A, END, P))])
    out = compute_changes(current, updates, ["id", "field"], ["value"], order_by=["n"], batch_timestamp=STAMP)
    assert got(out.insert) == want([(1, r(6, A, B, N)), (1, r(5, B, C, N)), (1, r(3, C, END, N))])
    assert "n" not in out.insert.columns


def test_pandas_in_and_out(spark):
    pd = pytest.importorskip("pandas")
    from chronolith.sources.frames import from_pandas, read, to_pandas, write

    frame = pd.DataFrame({"id": [2, 1], "value": [1.5, 2.5], "effective_from": pd.to_datetime(["2021-01-01", "2020-01-01"]), "effective_to": pd.to_datetime(["2022-01-01", "2021-01-01"]), "as_of_from": pd.to_datetime("2020-01-01"), "as_of_to": pd.Timestamp(INFINITY)}, index=[7, 7])
    df = from_pandas(spark, frame)
    out = compute_changes(df.limit(0), df, ["id"], ["value"])
    back = to_pandas(out.insert)
    assert back["id"].tolist() == [1, 2] and back["value"].tolist() == [2.5, 1.5] and "index" not in back.columns
    assert pd.Timestamp(back["effective_to"][0]) == pd.Timestamp("2021-01-01")
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        write(out.insert, f"{folder}/t")
        assert read(spark, f"{folder}/t").where("id = 1").count() == 1


def test_maintain_applies_each_batch_once(spark, tmp_path):
    """A stream of updates: the stored table after each batch, and a batch that is run again."""
    from chronolith.streaming.apply import maintain

    columns = ["id", "field"]
    state = {"rows": table(spark, [(1, r(3, A, END, P))]).collect(), "seen": set()}
    schema = table(spark, []).schema

    def load(session):
        return session.createDataFrame(state["rows"], schema)

    def store(df, number):
        if number not in state["seen"]:
            state["seen"].add(number)
            state["rows"] = df.select(schema.names).collect()

    source, done = tmp_path / "in", tmp_path / "done"
    for i, row in enumerate((r(4, B, C, N), r(5, C, END, N + 1))):
        table(spark, [(1, row)]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = maintain(stream, load, store, columns, ["value"], batch_timestamp=STAMP).option("checkpointLocation", str(done)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert len(state["seen"]) == i + 1
    live = [(x.value, day(x.effective_from), day(x.effective_to)) for x in state["rows"] if x.as_of_to == INFINITY]
    assert sorted(live) == [(3, A, B), (4, B, C), (5, C, END)]
    assert sum(x.as_of_to == STAMP for x in state["rows"]) == 2
