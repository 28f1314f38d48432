"""Benchmark decontamination: an FM-index for each shard of documents, asked for the benchmark's windows.

A shard is a run of rows inside a task, bounded in rows and bytes. Only its runs of words that the benchmark also
has, and that are as long as the shortest window, are indexed; no window can occur elsewhere. The suffix array of
those runs gives the Burrows-Wheeler transform, kept as a wavelet matrix of packed bits for ranks; all windows
are searched backwards together, and occurrences are located by walking to sampled suffixes.

The benchmark is a query set. Up to ``BLOCK`` bytes of it are broadcast at once, and a shard is indexed once for them;
a larger one is taken block after block, each in a scan of its own whose broadcast is dropped when it ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ALNUM_TABLE, bounded, free_name, lean, ship, utf8, written

WINDOW, STEP = 10, 8
#: Bytes of benchmark that are broadcast at once; rows and bytes of a shard, at most (a longer text is a shard).
BLOCK, SHARD_ROWS, SHARD_BYTES = 16_000_000, 2000, 8_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered."""
    return text.translate(ALNUM_TABLE).split() if text else []


class Bits:
    """Bits packed by 64, and how many are set before each pack: a little over one bit for each."""

    def __init__(self, bit: np.ndarray) -> None:
        padded = np.zeros(len(bit) // 64 * 64 + 64, np.uint8)
        padded[: len(bit)] = bit
        self.packs = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.packs), dtype=np.int64)[:-1]]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many are set before each place."""
        pack = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[pack] + np.bitwise_count(self.packs[pack] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packs[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Over numbers from 1 up, with 0 as a separator that no pattern has and that ends the text."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        stops = np.flatnonzero(text == 0)
        rank = text + len(stops) - 1
        rank[stops] = np.arange(len(stops))  # every separator is a letter of its own, so no suffix sorts far
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            sorted_rank = rank[order]
            new = np.r_[0, np.cumsum(sorted_rank[1:] != sorted_rank[:-1])]
            if step > 1:
                key2 = second[order]
                new = np.r_[0, np.cumsum((sorted_rank[1:] != sorted_rank[:-1]) | (key2[1:] != key2[:-1]))]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if not n or new[-1] == n - 1:
                break
            second = np.r_[rank[step:], np.full(min(step, n), -1)]
            order = np.argsort(rank * (n + 1) + second + 1, kind="stable")
            step *= 2
        self.n = n
        last = text[order - 1]
        top = int(text.max()) + 1 if n else 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top))]
        self.levels = max(1, int(top - 1).bit_length())
        self.ones, self.zeros, held = [], [], last
        for level in range(self.levels - 1, -1, -1):
            bit = held >> level & 1
            self.ones.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            held = np.r_[held[bit == 0], held[bit == 1]]
        starts = np.full(1 << self.levels, n)
        letters = np.unique(last)
        for c in letters.tolist():
            starts[c] = self._down(np.array([c]), np.array([0]))[0]
        self.start = starts
        sampled = order % STEP == 0
        sampled |= np.r_[True, text[:-1] == 0][order] if n else False  # a walk never crosses a separator
        self.place = np.where(sampled, order, -1)

    def _down(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k].ones(row)
            row = np.where(letter >> level & 1, self.zeros[k] + ones, row - ones)
        return row

    def rank(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each letter stands before the row in the transform."""
        return self._down(letter, row) - self.start[letter]

    def letter(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        for k in range(self.levels):
            bit, ones = self.ones[k].get(row), self.ones[k].ones(row)
            row = np.where(bit, self.zeros[k] + ones, row - ones)
            out = out << 1 | bit
        return out

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows of each pattern, a row of letters filled up with 0, read from the back."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        known = len(self.first) - 1
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((length >= back) & (low < high))
            c = patterns[live, length[live] - back]
            absent = c >= known
            low[live[absent]] = high[live[absent]] = 0
            live, c = live[~absent], c[~absent]
            there = self.start[c] < self.n
            low[live[~there]] = high[live[~there]] = 0
            live, c = live[there], c[there]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        row = row.copy()
        while len(live):
            at = self.place[row[live]]
            done = at >= 0
            out[live[done]] = at[done] + steps[live[done]]
            live = live[~done]
            c = self.letter(row[live])
            row[live] = self.first[c] + self.rank(c, row[live])
            steps[live] += 1
        return out


@dataclass
class Patterns:
    """A block's windows: words by number, windows as rows of numbers, and the items of each."""

    number: dict[bytes, int]
    windows: np.ndarray
    length: np.ndarray
    items: list[list[str]]
    shortest: int


def patterns(rows: list[tuple], window: int) -> Patterns:
    number: dict[bytes, int] = {}
    found: dict[tuple[int, ...], dict[str, None]] = {}
    for item, text in rows:
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(text.encode() if text is not None else None)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[at : at + window]), {})[str(item)] = None
    length = np.fromiter(map(len, found), np.int64, len(found))
    grid = np.zeros((len(found), window), np.int64)
    for i, w in enumerate(found):
        grid[i, : len(w)] = w
    return Patterns(number, grid, length, [list(x) for x in found.values()], int(length.min()) if len(length) else window)


def hits(words: list[list[bytes]], block: Patterns) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of one shard: starts of the texts in a common count of words, a mark for each hit word, and the items met."""
    start = np.r_[0, np.cumsum(list(map(len, words)))].astype(np.int64)
    mark, items = np.zeros(int(start[-1]) + 1, np.int64), [set() for _ in words]
    ids = np.concatenate([np.fromiter(map(block.number.get, w, repeat(0)), np.int64, len(w)) for w in words] or [np.zeros(0, np.int64)])
    if not len(ids) or not len(block.windows):
        return start, mark[:-1] > 0, items
    edge = ids == 0
    breaks = np.zeros(len(ids) + 1, bool)  # before each word
    breaks[start[:-1]] = breaks[-1] = True
    run = np.cumsum(breaks[:-1] | edge | np.r_[False, edge[:-1]])
    size = np.bincount(run)
    kept = np.flatnonzero(~edge & (size[run] >= block.shortest))
    if not len(kept):
        return start, mark[:-1] > 0, items
    new = np.r_[True, run[kept[1:]] != run[kept[:-1]]]
    text = np.zeros(len(kept) + int(new.sum()), np.int64)
    place = np.arange(len(kept)) + np.cumsum(new) - 1
    text[place] = ids[kept]
    source = np.full(len(text), -1)
    source[place] = kept
    index = FMIndex(text)
    low, high = index.search(block.windows, block.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = source[index.locate(rows)]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + block.length[which], -1)
    for doc, w in set(zip((np.searchsorted(start, at, side="right") - 1).tolist(), which.tolist())):
        items[doc].update(block.items[w])
    return start, np.cumsum(mark)[:-1] > 0, items


def _blocks(benchmark: DataFrame, window: int) -> Iterator:
    """Broadcasts of the benchmark's blocks, one after another, each dropped when the next is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // BLOCK))
    for k in range(count):
        rows = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        sent = spark.sparkContext.broadcast(patterns([tuple(r) for r in rows.collect()], window))
        yield sent, k, count
        if count > 1:
            sent.unpersist()


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
SPANS = "spans array<struct<first: bigint, `end`: bigint>>, items array<string>"


def _key() -> list[Column]:
    """Two hashes that name a row by its id and text; rows alike in both have the same hits."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.hash(F.col("text"), F.col("doc_id")).alias("b")]


def _found(docs: DataFrame, sent, every: bool) -> DataFrame:
    """``doc_id, a, b, n_words, spans, items`` of a block's hits in every row, or in those that have any."""
    rows = docs.select("doc_id", "text", *_key())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1, SHARD_ROWS, SHARD_BYTES):
            words = [words_of(t) for t in utf8(b.column(1))]
            start, mark, items = hits(words, sent.value)
            spans = [[{"first": f, "end": e} for f, e in _runs(mark[x:y])] if i else [] for x, y, i in zip(start[:-1], start[1:], items)]
            out = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(list(map(len, words)), pa.int64()), pa.array(spans, SPAN), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                names=["doc_id", "a", "b", "n_words", "spans", "items"],
            )
            yield out if every else out.filter(pa.array([bool(i) for i in items]))

    return rows.mapInArrow(lean(scan), f"doc_id {kind}, a bigint, b int, n_words bigint, {SPANS}")


def _united(spans: Column) -> Column:
    """Spans in order, those that overlap or touch made one."""

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["end"] >= x["first"]), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first: bigint, `end`: bigint>>"), add)


def _every_hit(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``doc_id, a, b, n_words, spans, items`` of every row, over all blocks of the benchmark."""
    first, more = None, []
    for sent, k, count in _blocks(benchmark, window):
        part = _found(docs, sent, k == 0)
        if count == 1:
            return part
        part = written(part, "hits")
        first, more = (part, more) if k == 0 else (first, [*more, part])
    names = ["a", "b"]
    every = reduce(DataFrame.unionByName, (p.select(*names, "spans", "items") for p in (first.where(F.size("items") > 0), *more))).distinct()
    met = every.groupBy(*names).agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    out = first.select("doc_id", *names, "n_words").join(met, names, "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", *names, "n_words", _united(F.coalesce("s", F.array().cast("array<struct<first: bigint, `end`: bigint>>"))).alias("spans"), F.coalesce("i", empty).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` of every whole text.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one
    window. spans: the merged hit words, as (first, end) word numbers. Null and empty texts have
    no words. Items with null or wordless texts have no windows; several rows of one item_id count as
    one item. Repeated rows each give a row; an empty benchmark hits nothing, an empty table gives no rows. Other columns are
    not read.
    """
    ship(docs.sparkSession)
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, x: t + x["end"] - x["first"])
    return _every_hit(docs, benchmark, window).select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "spans",
    )


_WORD = re.compile(rb"[^ ]+")


def without(text: bytes, mark: np.ndarray) -> bytes:
    """The text without its hit words and what stands between two of them in a row."""
    place = [m.span() for m in _WORD.finditer(text.translate(ALNUM_TABLE))]
    out, at = [], 0
    for first, end in _runs(mark):
        out.append(text[at : place[first][0]])
        at = place[end - 1][1]
    return b"".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with the benchmark's windows taken out of the texts.

    No row goes; ``n_chars``, where there is one, follows the text. Null and empty texts stay as they are, repeated
    rows are treated alike, and an empty table gives none. All other columns stay as they are, whatever their names.
    """
    ship(docs.sparkSession)
    blocks = _blocks(benchmark, window)
    sent, _, count = next(blocks)
    place, spans = docs.columns.index("text"), free_name("spans", docs.columns)
    if count > 1:
        blocks.close()
        a, b = (free_name(c, docs.columns) for c in ("a", "b"))
        met = _every_hit(docs, benchmark, window).where(F.size("items") > 0).select(F.col("a").alias(a), F.col("b").alias(b), F.col("spans").alias(spans)).distinct()
        key = [c.alias(n) for c, n in zip(_key(), (a, b))]
        rows = docs.select("*", *key).join(met, [a, b], "left").select(*docs.columns, spans)
    else:
        rows = docs

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, place, SHARD_ROWS, SHARD_BYTES):
            texts = utf8(batch.column(place))
            if count > 1:
                marks = [_mark(len(words_of(t)), s) if s else None for t, s in zip(texts, batch.column(spans).to_pylist())]
            else:
                start, mark, items = hits([words_of(t) for t in texts], sent.value)
                marks = [mark[x:y] if i else None for x, y, i in zip(start[:-1], start[1:], items)]
            new = [t if m is None else without(t, m) for t, m in zip(texts, marks)]
            columns = list(batch.columns)[: len(names)]
            columns[place] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    out = rows.mapInArrow(lean(scan), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _mark(n: int, spans: list[dict]) -> np.ndarray:
    out = np.zeros(n, bool)
    for s in spans:
        out[s["first"] : s["end"]] = True
    return out
