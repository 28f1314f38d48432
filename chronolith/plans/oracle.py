"""DuckDB SQL for the queries, written with range joins over each id's rows."""

from __future__ import annotations

INF, PAST, NOW, BATCH = (f"TIMESTAMP '{t}'" for t in ("2260-12-31 23:59:59", "1999-01-01 00:00:00", "2000-01-01 00:00:00", "2000-01-02 00:00:00"))
COLS = "o_custkey, o_orderstatus, o_totalprice, effective_from, effective_to, as_of_from, as_of_to"
CURRENT = f"""
cur AS (SELECT o_custkey, o_orderstatus, o_totalprice, d AS effective_from,
          coalesce(lead(d) OVER (PARTITION BY o_custkey ORDER BY d), {INF}) AS effective_to, {PAST} AS as_of_from, {INF} AS as_of_to
        FROM (SELECT *, o_orderdate::TIMESTAMP AS d, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1)"""
UPDATES = f"""
raw AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 14 = 0 THEN o_totalprice ELSE o_totalprice + 1000 END AS o_totalprice,
          o_orderdate::TIMESTAMP + INTERVAL 15 DAY AS effective_from, o_orderdate::TIMESTAMP + INTERVAL 75 DAY AS effective_to,
          {NOW} AS as_of_from, {INF} AS as_of_to, o_orderkey FROM orders WHERE o_orderkey % 7 = 0)"""
PLAIN = "upd AS (SELECT * FROM raw)"
#: Runs of equal values of one customer; the first order of a run stays.
CONFLATED = """
upd AS (SELECT o_custkey, o_orderstatus, o_totalprice, min(effective_from) AS effective_from, max(effective_to) AS effective_to,
          min(as_of_from) AS as_of_from, min(as_of_to) AS as_of_to, arg_min(o_orderkey, rn) AS o_orderkey
        FROM (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY rn) AS run FROM
          (SELECT *, CASE WHEN lag(effective_to) OVER w = effective_from AND lag(o_orderstatus) OVER w = o_orderstatus AND lag(o_totalprice) OVER w = o_totalprice THEN 0 ELSE 1 END AS brk
           FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_from, effective_to, o_orderkey) AS rn FROM raw)
           WINDOW w AS (PARTITION BY o_custkey ORDER BY rn)))
        GROUP BY o_custkey, o_orderstatus, o_totalprice, run)"""
SAME = "c.o_custkey = u.o_custkey AND c.o_orderstatus = u.o_orderstatus AND c.o_totalprice = u.o_totalprice"
MEET = "c.effective_from < u.effective_to AND c.effective_to > u.effective_from"
TOUCH = "(c.effective_to = u.effective_from OR u.effective_to = c.effective_from)"
DELTA = f"""
left_ AS (SELECT * FROM upd u WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE {SAME} AND {MEET})),
flag AS (SELECT *, EXISTS (SELECT 1 FROM cur c WHERE c.o_custkey = u.o_custkey AND {MEET}) AS inter,
           EXISTS (SELECT 1 FROM cur c WHERE {SAME} AND {TOUCH}) AS adj FROM left_ u),
line AS (SELECT * FROM flag WHERE inter OR adj),
alone AS (SELECT * FROM flag WHERE NOT inter AND NOT adj),
hit AS (SELECT * FROM cur c WHERE EXISTS (SELECT 1 FROM left_ u WHERE c.o_custkey = u.o_custkey AND {MEET})
          OR EXISTS (SELECT 1 FROM flag u WHERE NOT inter AND {SAME} AND {TOUCH}))"""
#: Distinct rows by range and values, then runs end to end with equal values.
MERGE = f"""
dist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_totalprice, effective_from, effective_to ORDER BY as_of_from) AS k FROM made) WHERE k = 1),
numb AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_from, effective_to, ord) AS rn FROM dist),
brks AS (SELECT *, CASE WHEN lag(effective_to) OVER w = effective_from AND lag(o_orderstatus) OVER w = o_orderstatus AND lag(o_totalprice) OVER w = o_totalprice THEN 0 ELSE 1 END AS brk
         FROM numb WINDOW w AS (PARTITION BY o_custkey ORDER BY rn)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY rn) AS run FROM brks)
SELECT o_custkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice, min(effective_from) AS effective_from,
       max(effective_to) AS effective_to, arg_min(as_of_from, rn) AS as_of_from, arg_min(as_of_to, rn) AS as_of_to
FROM runs GROUP BY o_custkey, run"""
SEGMENTS = f"""
pts AS (SELECT DISTINCT o_custkey, unnest([effective_from, effective_to]) AS t FROM (SELECT o_custkey, effective_from, effective_to FROM line UNION ALL SELECT o_custkey, effective_from, effective_to FROM hit)),
seg AS (SELECT o_custkey, t AS a, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS b FROM pts),
cand AS (SELECT s.*, 0 AS side, l.o_orderstatus, l.o_totalprice, l.effective_from AS f, l.o_orderkey AS ord, l.as_of_from FROM seg s JOIN line l ON s.o_custkey = l.o_custkey AND l.effective_from <= a AND l.effective_to >= b
         UNION ALL SELECT s.*, 1, h.o_orderstatus, h.o_totalprice, h.effective_from, 0, (SELECT arg_min(as_of_from, o_orderkey) FROM line l WHERE l.o_custkey = s.o_custkey)
         FROM seg s JOIN hit h ON s.o_custkey = h.o_custkey AND h.effective_from <= a AND h.effective_to >= b),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, a ORDER BY side, f, ord) AS k FROM cand WHERE b IS NOT NULL) WHERE k = 1),
made AS (SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, effective_to, as_of_from, {INF} AS as_of_to, o_orderkey AS ord FROM alone
         UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice, a, b, as_of_from, {INF}, ord FROM win),"""
FULL = f"""
m AS (SELECT u.*, c.effective_from AS cf, c.effective_to AS ct,
        CASE WHEN c.effective_from IS NULL THEN 9 WHEN c.effective_from = u.effective_from AND c.effective_to = u.effective_to THEN 0 WHEN {TOUCH} THEN 1 ELSE 2 END AS kind
      FROM upd u LEFT JOIN cur c ON {SAME}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY kind, CASE WHEN kind = 1 THEN -epoch(cf) ELSE epoch(cf) END) AS k FROM m) WHERE k = 1),
cs AS (SELECT *, CASE WHEN kind = 9 THEN '4' WHEN kind = 0 THEN '2' WHEN kind = 1 THEN CASE WHEN year(ct) < 2200 AND year(effective_to) >= 2200 THEN '1a' ELSE '1b' END
         WHEN cf <= effective_from AND ct >= effective_to THEN '3a' WHEN cf = effective_from AND effective_to > ct THEN '3b' ELSE '3c' END AS "case" FROM best),
queued AS (SELECT o_custkey, arg_min("case", o_orderkey) AS first_case FROM cs WHERE "case" IN ('1a', '3b', '3c', '4') GROUP BY 1),
absent AS (SELECT * FROM cur WHERE o_custkey NOT IN (SELECT o_custkey FROM upd) AND effective_from < {NOW}),
stamp AS (SELECT arg_min(as_of_from, o_orderkey) AS s FROM upd),
gone AS (SELECT c.* FROM cur c LEFT JOIN queued q USING (o_custkey) WHERE q.first_case = '4'
           OR EXISTS (SELECT 1 FROM cs u WHERE u."case" IN ('1b', '3b') AND {SAME} AND u.cf = c.effective_from AND u.ct = c.effective_to)
         UNION ALL SELECT * FROM absent),
made AS (SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, effective_to, as_of_from, as_of_to, o_orderkey AS ord FROM cs WHERE "case" IN ('1a', '3b', '3c', '4')
         UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice, least(cf, effective_from), greatest(ct, effective_to), (SELECT s FROM stamp), as_of_to, o_orderkey FROM cs WHERE "case" = '1b'
         UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, {NOW}, (SELECT s FROM stamp), as_of_to, 0 FROM absent)"""
EVENTS = f"""
ev AS (SELECT user_id, event_type, floor(value / 50)::BIGINT AS bucket, t AS effective_from, coalesce(lead(t) OVER (PARTITION BY user_id, event_type ORDER BY t), {INF}) AS effective_to,
         {PAST} AS as_of_from, {INF} AS as_of_to
       FROM (SELECT *, ts::TIMESTAMP AS t, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS k FROM events) WHERE k = 1)"""
RUNS = """
SELECT {cols}, min(effective_from) AS effective_from, max(effective_to) AS effective_to, min(as_of_from) AS as_of_from, min(as_of_to) AS as_of_to
FROM (SELECT *, sum(brk) OVER (PARTITION BY {key} ORDER BY {order}) AS run FROM
  (SELECT *, CASE WHEN lag(effective_to) OVER w = effective_from AND {same} THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY {key} ORDER BY {order})))
GROUP BY {cols}, run"""
LE = lambda e, size=8: "unhex(" + " || ".join(f"substr(printf('%016X', {e}), {15 - 2 * k}, 2)" for k in range(size)) + ")"

#: The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_times = lambda x, y: f"((({x})::UHUGEINT * ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
_plus = lambda x, y: f"((({x})::UHUGEINT + ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
_turned = lambda x, k: f"({_times(x, 2**k)} | (({x}) >> {64 - k}))"


def xxh64(table: str, lanes: list[str], single: list[str]) -> str:
    """SQL for the rows of a table with ``h``: XXH64 (seed 0) of a payload of fewer than 32 bytes, given as longs and then bytes."""
    out = f"SELECT *, {P5 + 8 * len(lanes) + len(single)}::UBIGINT AS h FROM {table}"
    for lane in lanes:
        out = f"SELECT * REPLACE ({_times(f'({lane})::UBIGINT', P2)} AS h), h AS kept FROM ({out})"
        out = f"SELECT * EXCLUDE (kept) REPLACE (xor(kept, {_times(_turned('h', 31), P1)}) AS h) FROM ({out})"
        out = f"SELECT * REPLACE ({_plus(_times(_turned('h', 27), P1), P4)} AS h) FROM ({out})"
    for byte in single:
        out = f"SELECT * REPLACE (xor(h, {_times(f'({byte})::UBIGINT', P5)}) AS h) FROM ({out})"
        out = f"SELECT * REPLACE ({_times(_turned('h', 11), P1)} AS h) FROM ({out})"
    for shift, prime in ((33, P2), (29, P3)):
        out = f"SELECT * REPLACE ({_times(f'xor(h, h >> {shift})', prime)} AS h) FROM ({out})"
    return f"SELECT * REPLACE (xor(h, h >> 32) AS h) FROM ({out})"


#: The bits of a positive double that is no whole number, by its exponent and what is left of it.
_power = "CASE WHEN x / pow(2.0, e) >= 2 THEN e + 1 WHEN x / pow(2.0, e) < 1 THEN e - 1 ELSE e END"
TYPED = f"""
a AS (SELECT *, l_extendedprice AS x, floor(log2(greatest(l_extendedprice, 1e-9)))::BIGINT AS e FROM lineitem),
b AS (SELECT * REPLACE ({_power} AS e) FROM a),
c AS (SELECT *, CASE WHEN x = floor(x) THEN x::BIGINT ELSE (e + 1023) * 4503599627370496 + ((x / pow(2.0, e) - 1) * 4503599627370496)::BIGINT END AS bits FROM b)"""


def oracle_sql() -> dict[str, str]:
    base = f"WITH {CURRENT}, {UPDATES}"
    plain = f"{base}, {PLAIN}"
    delta = f"{plain}, {DELTA}"
    full = f"{plain}, {FULL}"
    expired = f"SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, effective_to, as_of_from, {BATCH} AS as_of_to FROM hit"
    inserted = f"{DELTA}, {SEGMENTS}{MERGE}"
    applied = f"{delta}, ins AS (WITH {SEGMENTS}{MERGE}), app AS (SELECT {COLS} FROM cur EXCEPT ALL SELECT {COLS} FROM hit UNION ALL {expired} UNION ALL SELECT {COLS} FROM ins)"
    return {
        "normalize_infinity": f"{base} SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, CASE WHEN o_custkey % 3 < 2 THEN {INF} ELSE effective_to END AS effective_to, as_of_from, {INF} AS as_of_to FROM cur",
        "validate_and_align": f"{base} SELECT {COLS}, 'current' AS side FROM cur UNION ALL SELECT {COLS}, 'updates' FROM raw",
        "schema_checks": f"SELECT unnest(string_split('{COLS}, note', ', ')) AS without, unnest(string_split('{COLS}, note', ', ')) = 'note' AS valid",
        "hash_sha256_values": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 2 = 0 AS even, sha256({LE('o_orderkey')} || {LE('o_custkey')} || encode(o_orderstatus) || CASE WHEN o_orderkey % 2 = 0 THEN '\\x01'::BLOB ELSE '\\x00'::BLOB END) AS value_hash FROM orders",
        "hash_xxh64_values": f"SELECT o_orderkey, o_custkey, o_orderstatus, even, printf('%016x', h) AS value_hash FROM ({xxh64('(SELECT *, o_orderkey % 2 = 0 AS even FROM orders)', ['o_orderkey', 'o_custkey'], ['ascii(o_orderstatus)', 'even::INT'])})",
        "hash_typed_values": f"WITH {TYPED} SELECT l_orderkey, l_linenumber, sha256({LE('l_quantity::BIGINT')} || {LE('bits')} || {LE('(l_shipdate::DATE - DATE \'1970-01-01\')::BIGINT', 4)} || {LE('epoch_us(l_shipdate)')} || {LE('round(l_tax * 100)::BIGINT')} || {LE('0::BIGINT')} || CASE WHEN l_linenumber = 3 THEN 'NULL'::BLOB ELSE {LE('l_linenumber::BIGINT')} END || 'NULL'::BLOB) AS value_hash FROM c",
        "no_change_updates": f"{plain} SELECT {COLS} FROM upd u WHERE EXISTS (SELECT 1 FROM cur c WHERE {SAME} AND {MEET})",
        "overlap_pairs": f"{plain} SELECT c.o_custkey, c.o_orderkey AS first_key, u.o_orderkey AS second_key FROM upd c JOIN upd u ON c.o_custkey = u.o_custkey AND c.o_orderkey < u.o_orderkey AND {MEET}",
        "adjacent_pairs": f"WITH {EVENTS} SELECT a.user_id, a.event_type, a.bucket, a.effective_from, b.effective_from AS next_from FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.bucket = b.bucket AND a.effective_to = b.effective_from",
        "affected_current": f"{delta} SELECT {COLS} FROM hit",
        "categorize_updates": f"{delta} SELECT {COLS}, CASE WHEN inter OR adj THEN 'overlapping' ELSE 'alone' END AS category FROM flag",
        "elementary_segments": f"{plain}, pts AS (SELECT DISTINCT o_custkey, unnest([effective_from, effective_to]) AS t FROM (SELECT o_custkey, effective_from, effective_to FROM cur UNION ALL SELECT o_custkey, effective_from, effective_to FROM upd)), s AS (SELECT o_custkey, t AS segment_from, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS segment_to FROM pts) SELECT * FROM s WHERE segment_to IS NOT NULL",
        "segment_winner": f"{plain}, pts AS (SELECT DISTINCT o_custkey, unnest([effective_from, effective_to]) AS t FROM upd), s AS (SELECT o_custkey, t AS a, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS b FROM pts), w AS (SELECT s.o_custkey, a, b, arg_min(o_orderkey, (effective_from, o_orderkey)) AS o_orderkey FROM s JOIN upd u ON s.o_custkey = u.o_custkey AND effective_from <= a AND effective_to >= b GROUP BY ALL) SELECT o_custkey, o_orderkey, min(a) AS effective_from, max(b) AS effective_to FROM w GROUP BY 1, 2",
        "conflate_inputs": f"WITH {EVENTS} " + RUNS.format(cols="user_id, event_type, bucket", key="user_id, event_type", order="effective_from", same="lag(bucket) OVER w = bucket"),
        "conflate_outputs": f"WITH {EVENTS} " + RUNS.format(cols="user_id, event_type, bucket", key="user_id", order="effective_from, effective_to, event_type", same="lag(bucket) OVER w = bucket AND lag(event_type) OVER w = event_type"),
        "dedup_segments": f"WITH {EVENTS} SELECT DISTINCT * FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev)",
        "open_ended_rows": f"{base} SELECT o_custkey, effective_from, year(effective_to) >= 2200 AS is_open, year(effective_to) < 2200 AS stays_apart FROM cur",
        "delta_expire": f"{delta} {expired}",
        "delta_insert": f"{plain}, {inserted}",
        "delta_conflated": f"{base}, {CONFLATED}, {inserted}",
        "full_state_expire": f"{full} SELECT DISTINCT g.o_custkey, g.o_orderstatus, g.o_totalprice, g.effective_from, coalesce((SELECT arg_max(u.effective_to, u.o_orderkey) FROM upd u WHERE u.o_custkey = g.o_custkey AND u.effective_from = g.effective_from), g.effective_to) AS effective_to, g.as_of_from, {BATCH} AS as_of_to FROM gone g",
        "full_state_insert": f"{full}, {MERGE}",
        "full_state_conflated": f"{base}, {CONFLATED}, {FULL}, {MERGE}",
        "full_state_tombstones": f"{full} SELECT o_custkey, o_orderstatus, o_totalprice, effective_from, {NOW} AS effective_to, {NOW} AS as_of_from, as_of_to FROM absent",
        "full_state_case_counts": f'{full} SELECT "case", count(*) AS n FROM cs GROUP BY 1',
        "apply_changeset": f"{applied} SELECT * FROM app",
        "as_of_snapshot": f"{applied} SELECT * FROM app WHERE effective_from <= TIMESTAMP '1996-06-01' AND effective_to > TIMESTAMP '1996-06-01' AND as_of_from <= {BATCH} AND as_of_to > {BATCH}",
    }
