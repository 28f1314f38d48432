"""Change sets of bitemporal tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.constants import AF, AT, CHANGE, DELTA, EF, ET, HASH, INFINITY, MODES
from chronolith.functions.hashing import algorithm, has_hashes, value_hash
from chronolith.functions.intervals import conflate_updates
from chronolith.operators import delta, full_state
from chronolith.operators.normalize import align, check, instant, lean, normalize_temporal, restore_infinity, temporal_types, unfolded, validate_schema


class ChangeSet(tuple):
    """``(expire, insert)``: rows to expire, as they are to be stored, and rows to insert.

    Both are lazy and each computes what it needs. ``both`` has the rows of the two, told apart by
    its column ``change`` (expire or insert), from one pass over the inputs: to store both, write it once.
    """

    both: DataFrame

    def __new__(cls, expire: DataFrame, insert: DataFrame, both: DataFrame | None = None) -> ChangeSet:
        out = super().__new__(cls, (expire, insert))
        mark = lambda df, name: df.withColumn(CHANGE, F.lit(name))
        out.both = mark(expire, delta.EXPIRE).unionByName(mark(insert, delta.INSERT)) if both is None else both
        return out

    @property
    def expire(self) -> DataFrame:
        return self[0]

    @property
    def insert(self) -> DataFrame:
        return self[1]


def _day(system_date: str | date | None) -> datetime:
    if system_date is None:
        system_date = date.today()
    if isinstance(system_date, str):
        system_date = datetime.strptime(system_date, "%Y-%m-%d").date()
    return datetime(system_date.year, system_date.month, system_date.day)


@dataclass
class Prepared:
    """Inputs after normalisation, alignment and hashing, lean; the columns they had; which of them are empty."""

    current: DataFrame
    updates: DataFrame
    keys: list[str]
    order: list[str]
    names: list[str]
    kinds: dict[str, str]
    no_current: bool
    no_updates: bool


def prepare(
    current: DataFrame, updates: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str], hash_algorithm: str = "xxhash",
    conflate_inputs: bool = False, order_by: Sequence[str] = (), trust_hash: bool | None = None, look: bool = True,
) -> Prepared:
    """trust_hash: take each side's ``value_hash`` as it is (True) or make all anew (False); by default a small job looks whether they are whole.

    look: run a small job on each input to see whether it is empty; without, both are taken to have rows.
    """
    empty = (current.isEmpty(), updates.isEmpty()) if look else (False, False)
    sides = {"current": current, "updates": updates}
    for name, df in sides.items():
        if df.columns or not empty[name == "updates"]:
            check(df, id_columns, value_columns)
    kinds = temporal_types(*(df for df in (current, updates) if df.columns))
    order = updates.select(*order_by).columns if order_by else []
    brought = {k: HASH in df.columns and (has_hashes(df) if trust_hash is None else trust_hash) for k, df in sides.items()}
    held = {k: [F.col(f"`{c}`").alias(f"_o{i}") if c in df.columns else F.lit(None).cast(updates.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)] for k, df in sides.items()}
    names = [f"_o{i}" for i in range(len(order))]
    sides = {k: normalize_temporal((df if HASH in df.columns else df.withColumn(HASH, F.lit(""))).select("*", *held[k]), kinds) for k, df in sides.items()}
    if not empty[0]:
        sides = dict(zip(sides, align(sides["current"], sides["updates"])))
    columns = [c for c in sides["updates"].columns if c not in names]
    keys = [f"_k{i}" for i in range(len(id_columns))]
    made: dict[tuple, Column] = {}  # sides of the same types share one expression
    for k, df in sides.items():
        if not set(id_columns) <= set(df.columns):  # an empty table without columns
            continue
        if not brought[k]:
            kinds_of = tuple(f.dataType for f in df.schema if f.name in value_columns)
            if kinds_of not in made:
                made[kinds_of] = value_hash(df, value_columns, hash_algorithm)
            df = df.withColumn(HASH, made[kinds_of])
        sides[k] = lean(df, id_columns, names)
    order = ["_o"] if order else []
    if conflate_inputs:
        sides["updates"] = conflate_updates(sides["updates"], keys, order or [HASH])
    return Prepared(sides["current"], sides["updates"], keys, order, columns, kinds, *empty)


def compute_changes(
    current: DataFrame, updates: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str],
    system_date: str | date | None = None, update_mode: str = DELTA, conflate_inputs: bool = False, hash_algorithm: str = "xxhash",
    batch_timestamp: datetime | None = None, order_by: Sequence[str] = (), strict: bool = False, trust_hash: bool | None = None, look: bool = True,
) -> ChangeSet:
    """The rows to expire and to insert so that ``current`` says what ``updates`` say.

    ``delta``: updates overwrite what they cover. ``full_state``: updates are the whole state; ids without any get
    tombstones that end at midnight of ``system_date``. ``order_by`` gives the input order where it
    matters (updates' columns); by default rows count by range and hash. ``strict`` leaves rows that have
    ended by ``system_date`` without a tombstone. The results are lazy; only the looks for
    empty inputs (``look``) and whole hashes (``trust_hash``) run small jobs.
    """
    if update_mode not in MODES:
        raise ValueError(f"unknown update mode {update_mode!r}: use one of {', '.join(MODES)}")
    algorithm(hash_algorithm)
    day = _day(system_date)
    stamp = batch_timestamp or datetime.now(timezone.utc).replace(tzinfo=None)
    got = prepare(current, updates, id_columns, value_columns, hash_algorithm, conflate_inputs, order_by, trust_hash, look)
    batch, midnight, end = instant(stamp, got.kinds[AT]), instant(day, got.kinds[ET]), instant(INFINITY, got.kinds[AT])
    plain = lambda df, *more: unfolded(df, got.names, id_columns, *more)
    if got.no_current:
        updates = plain(got.updates)
        nothing = updates.where(F.lit(False))
        return ChangeSet(nothing, restore_infinity(nothing if got.no_updates else updates))
    if got.no_updates and update_mode == DELTA:
        nothing = plain(got.current).where(F.lit(False))
        return ChangeSet(nothing, nothing)
    if update_mode == DELTA:
        rows = delta.roles(got.current, got.updates, got.keys, got.order)
        both, expired = delta.changes(rows, got.keys, got.order, batch, end), delta.expired(rows, batch)
    else:
        rows = full_state.classified(got.current, got.updates, got.keys, got.order)
        if got.no_updates:
            rows = rows.withColumn("_stamp", instant(stamp, got.kinds[AF]))
        else:
            # one row: the as_of_from of the first update of the batch
            rows = rows.crossJoin(F.broadcast(got.updates.agg(F.min_by(AF, F.struct(*got.order, EF, ET, HASH)).alias("_stamp"))))
        both, expired = full_state.changes(rows, got.keys, got.order, midnight, batch, strict), full_state.expired(rows, midnight, batch, strict)
    insert = restore_infinity(plain(both.where(F.col("_change") == delta.INSERT)))
    made = F.col(CHANGE) == delta.INSERT
    both = restore_infinity(plain(both, F.col("_change").alias(CHANGE)), made)
    return ChangeSet(plain(expired), insert, both)


class BitemporalProcessor:
    """Ids, values and a default for input conflation; see :func:`compute_changes`."""

    def __init__(self, id_columns: Sequence[str], value_columns: Sequence[str], conflate_inputs: bool = False) -> None:
        self.id_columns, self.value_columns, self.conflate_inputs = list(id_columns), list(value_columns), conflate_inputs

    def compute_changes(self, current_state: DataFrame, updates: DataFrame, system_date=None, update_mode: str = DELTA, conflate_inputs: bool | None = None, **options) -> ChangeSet:
        conflate = self.conflate_inputs if conflate_inputs is None else conflate_inputs
        return compute_changes(current_state, updates, self.id_columns, self.value_columns, system_date, update_mode, conflate, **options)

    process_updates = compute_changes

    def validate_schema(self, df: DataFrame) -> bool:
        return validate_schema(df, self.id_columns, self.value_columns)
