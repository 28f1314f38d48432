"""Best-fit packing of token sequences by the sum-of-squares rule.

A piece goes where the sum of the squared counts of open sequences per residual gap becomes
smallest. Only the count of each gap matters for the choice, so a choice looks at one array of
``SIZE`` numbers. Each task packs its own rows a window at a time, longest piece first, and carries the open
sequences on to its next window. What is left open when tasks end is then packed again, pieces of many
tasks together, by their lengths alone: so the count of sequences does not grow with that of tasks.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import bounded, cut, lean, ship, utf8, written

SIZE, END, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Tokens and pieces of a window, and white-space separated strings kept with their ids, at most.
WINDOW_TOKENS, WINDOW_PIECES, KEPT = 6_000_000, 50_000, 500_000
#: Parts of a lower-cased string of Latin letters, digits and signs that the tokenizer treats one by one.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]|[^\\sa-z0-9\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Strings that PARTS covers: others go through the whole tokenizer.
COVERED = re.compile("[\x21-\x7e\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,40}")
#: One word of Latin letters, with a stop or comma behind it or not: by far most strings.
PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,]?$"
#: Ids kept with the strings, bytes of a string that is kept, and bytes of the texts of a call, at most.
KEPT_IDS, LONG, CALL_BYTES = 6_000_000, 160, 4_000_000
NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges of many parts at a time, as arrays.

    Every round merges the pair of lowest rank, the leftmost first, in each part that has one.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(seen))}
        self.inner = np.array([ids[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[shown[b] + self.end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[x] << 20 | ids[y] for x, y in pairs], np.int64)
        into = np.array([ids[x + y] for x, y in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.into = key[order], order.astype(np.int32), into

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def __call__(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, as bytes of unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            n, wide = size[rows], int(size[rows[-1]])
            raw = np.frombuffer(b"".join(parts[i].ljust(wide, b"\0") for i in rows), np.uint8).reshape(-1, wide)
            symbols = np.where(np.arange(wide) < n[:, None], self.inner[raw], -1)
            symbols[np.arange(len(rows)), n - 1] = self.last[raw[np.arange(len(rows)), n - 1]]
            live = np.arange(len(rows))
            done = np.empty_like(symbols)
            rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
            now = symbols
            while len(live):
                if rank.shape[1]:
                    best = rank.argmin(1)
                    value = rank[np.arange(len(live)), best]
                else:
                    value = np.full(len(live), NONE)
                stop = value == NONE
                if stop.any():
                    done[live[stop]] = now[stop]
                    live, now, rank, value = live[~stop], now[~stop], rank[~stop], value[~stop]
                    if not len(live):
                        break
                    best = best[~stop]
                i = np.arange(len(live))
                now[i, best] = self.into[value]
                place = np.arange(wide)
                now = np.take_along_axis(now, np.minimum(place + (place > best[:, None]), wide - 1), 1)
                now[:, -1] = -1
                slot = np.arange(wide - 1)
                rank = np.take_along_axis(rank, np.minimum(slot + (slot > best[:, None]), wide - 2), 1)
                rank[:, -1] = NONE
                right = best < wide - 1
                rank[i[right], best[right]] = self.ranks(now[i[right], best[right]], now[i[right], best[right] + 1])
                left = best > 0
                rank[i[left], best[left] - 1] = self.ranks(now[i[left], best[left] - 1], now[i[left], best[left]])
            count = (done >= 0).sum(1) * 4
            flat = done.astype(np.uint32).tobytes()
            for k, start, length in zip(rows.tolist(), range(0, len(flat), 4 * wide), count.tolist()):
                out[k] = flat[start : start + length]
        return out


#: What the cutting below takes for granted of a tokenizer (fixed values); any other is used as it is.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def is_known(path: str) -> bool:
    """Whether a tokenizer file has the parts that :class:`Tokens` follows."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return (
        found.get("normalizer") == NORMALIZER and found.get("pre_tokenizer") == PRE_TOKENIZER and found.get("post_processor") is None
        and found.get("truncation") is None and {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")} == MODEL
        and all(t["content"].startswith("<|") for t in found["added_tokens"])
    )


class Plain:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]


def _ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of a pool on end."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Ids of whole texts, by a tokenizer that never looks across white space.

    Arrow cuts texts into strings and numbers them; each distinct one is looked up among those met before. New
    ones of Latin letters, digits and signs are cut as the tokenizer cuts them and merged together in arrays; any
    other goes through the tokenizer itself. ``start`` and ``length`` are each known string's run of ids in the pool.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.start, self.length, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, strings: list[bytes]) -> np.ndarray:
        """Of each string its number, -1 if it is not known."""
        return np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))

    def _ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool, and the run in it of each of some distinct parts, which are strings too."""
        at = self._numbers(parts)
        fresh = np.flatnonzero(at < 0)
        made = self.merges([parts[i] for i in fresh.tolist()])
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        start, length = self.start[at], self.length[at]
        start[fresh], length[fresh] = len(self.pool) + np.cumsum(size) - size, size
        return np.concatenate([self.pool, np.frombuffer(b"".join(made), np.uint32)]), start, length

    def _learn(self, strings: pa.Array) -> None:
        plain = pc.and_(pc.match_substring_regex(strings, PLAIN), pc.less_equal(pc.utf8_length(strings), 40))
        some = strings.filter(plain)
        sign = np.select([pc.ends_with(some, x).to_numpy(zero_copy_only=False) for x in ".,"], [1, 2], 0)
        body = pc.utf8_rtrim(pc.utf8_lower(some), ".,").dictionary_encode()
        bodies = utf8(body.dictionary)
        pool, start, length = self._ids([*bodies, b"", b".", b","])
        n = len(bodies)
        # a body's ids, then its sign's
        at = np.stack([body.indices.to_numpy(), n + sign], 1).ravel()
        joined = _ragged(pool, start[at], length[at])
        size = np.zeros(len(strings), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        size[is_plain] = length[at].reshape(-1, 2).sum(1)
        # the others: parts where they can be cut, else the tokenizer's ids, which join the pool as parts of their own
        rest = [self._cut(x) for x in strings.filter(pc.invert(plain)).to_pylist()]
        number = {p: i for i, p in enumerate(sorted({p for x in rest if isinstance(x, list) for p in x}))}
        pool, start, length = self._ids([p.encode() for p in number])
        told = [x for x in rest if not isinstance(x, list)]
        size_told = np.fromiter(map(len, told), np.int64, len(told))
        start = np.r_[start, len(pool) + np.cumsum(size_told) - size_told]
        length, pool = np.r_[length, size_told], np.concatenate([pool, *told])
        next_told = iter(range(len(number), len(start)))
        each = [[number[p] for p in x] if isinstance(x, list) else [next(next_told)] for x in rest]
        at = np.array([i for x in each for i in x], np.int64)
        other = _ragged(pool, start[at], length[at])
        ends = np.r_[0, np.cumsum(length[at])][np.cumsum([0, *map(len, each)])]
        size[~is_plain] = np.diff(ends)
        place = np.zeros(len(strings), np.int64)
        place[is_plain] = np.cumsum(size[is_plain]) - size[is_plain]
        place[~is_plain] = len(joined) + np.cumsum(size[~is_plain]) - size[~is_plain]
        self.known.update(zip(utf8(strings), range(len(self.start), len(self.start) + len(strings))))
        self.start, self.length = np.r_[self.start, len(self.pool) + place], np.r_[self.length, size]
        self.pool = np.concatenate([self.pool, joined, other], dtype=np.uint32)

    def _cut(self, text: str) -> list[str] | np.ndarray:
        """A string's parts, or its ids where only the tokenizer can tell."""
        if COVERED.fullmatch(text) and "<|" not in text:
            return PARTS.findall(text.lower())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. What is kept between calls is bounded by KEPT strings and those of one call."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        strings = utf8(coded.dictionary)
        at = self._numbers(strings)
        new = at < 0
        if new.any():
            if len(self.known) + int(new.sum()) > KEPT or len(self.pool) > KEPT_IDS:
                self._forget()
                at = self._numbers(strings)
                new = at < 0
            at[new] = len(self.start) + np.arange(int(new.sum()))
            self._learn(coded.dictionary.filter(pa.array(new)))
        each = at[coded.indices.to_numpy()]
        length = self.length[each]
        ids = _ragged(self.pool, self.start[each], length)
        cuts = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(split.value_lengths().to_numpy())]]
        for string in [x for x in strings if len(x) > LONG]:
            del self.known[string]
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def tokens(path: str) -> Tokens | Plain:
    """One of these for each worker process and vocabulary; what it has met serves later tasks too."""
    held = sys.modules.setdefault("_chronolith_tokens", types.ModuleType("_chronolith_tokens"))
    if path not in held.__dict__:
        held.__dict__[path] = Tokens(path) if is_known(path) else Plain(path)
    return held.__dict__[path]


class Packer:
    """Open sequences by residual gap."""

    def __init__(self, size: int = SIZE) -> None:
        self.size, self.made = size, 0
        self.count = np.zeros(size + 1, np.int64)  # open sequences with a gap; 0 and size stay out
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence of a piece and its offset there.

        Taking gap g changes the sum of squares by 2 (count[g - length] - count[g]) + 2, where gaps
        of 0 count nothing. A tie goes to the smallest gap. A new sequence is not weighed against open ones: it is
        begun only where none has room, as few sequences come before an even count.
        """
        size, count = self.size, self.count
        at, gap = -1, size
        if length < size:
            change = 2 * (count[: size - length] - count[length:size]) + 2
            change[0] -= 1  # a full sequence leaves the count
            change[count[length:size] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] != np.iinfo(np.int64).max:
                gap = best + length
                at = self.open[gap].pop()
                count[gap] -= 1
        if at < 0:
            at, self.made = self.made, self.made + 1
        rest = gap - length
        if rest:
            self.open[rest].append(at)
            count[rest] += 1
        return at, size - gap


#: A sequence with so large a gap when its task ends is packed again; pieces that are packed together then.
TAIL, GROUP = 16, 100_000


def _by_task(docs: DataFrame, vocabulary: str, size: int, ids: bool) -> DataFrame:
    """The pieces as their tasks pack them, each with a ``number``; and for each sequence still open a row with its gap in ``start`` and no number.

    ``ids``: the pieces' ids, or only their CRC32.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    value, told = (pa.binary(), "ids binary") if ids else (pa.int64(), "ids_crc32 bigint")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokens(vocabulary).many, Packer(size)
        first = TaskContext.get().partitionId() << 40
        names = ["doc_id", "piece", "start", "length", "sequence_id", "offset", told.split()[0], "number"]
        held: list[tuple] = []
        weight = number = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            at: list = [None] * len(held)
            for i in sorted(range(len(held)), key=lambda i: -held[i][3]):
                at[i] = packer.place(held[i][3])
            for k in range(0, len(held), 2000):
                doc, piece, start, length, raw = zip(*held[k : k + 2000])
                where = at[k : k + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, known), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([first + s for s, _ in where], pa.int64()),
                     pa.array([o for _, o in where], pa.int64()), pa.array(raw, value), pa.array(range(first + number, first + number + len(where)), pa.int64())],
                    names=names,
                )
                number += len(where)

        known = pa.int64()
        for b in bounded(batches, 1, 4000, CALL_BYTES):
            known = b.column(0).type
            for doc_id, got in zip(b.column(0).to_pylist(), encode(b.column(1))):
                raw = np.append(got, np.uint32(END))
                for piece, start in enumerate(range(0, len(raw), size)):
                    part = raw[start : start + size].tobytes()
                    held.append((doc_id, piece, start, len(part) // 4, part if ids else zlib.crc32(part)))
                    weight += len(part) // 4
                    if weight >= WINDOW_TOKENS or len(held) >= WINDOW_PIECES:
                        yield from packed()
                        held, weight = [], 0
        if held:
            yield from packed()
        left = [(gap, s) for gap, at in enumerate(packer.open) for s in at]
        if left:
            gap, at = zip(*left)
            empty = [pa.nulls(len(left), t) for t in (known, pa.int32(), pa.int64(), pa.int64(), value, pa.int64())]
            yield pa.RecordBatch.from_arrays([empty[0], empty[1], pa.array(gap, pa.int64()), empty[2], pa.array([first + s for s in at], pa.int64()), empty[3], empty[4], empty[5]], names=names)

    return rows.mapInArrow(lean(scan), f"doc_id {kind}, piece int, start bigint, length bigint, sequence_id bigint, `offset` bigint, {told}, number bigint")


def _again(tails: DataFrame, size: int) -> DataFrame:
    """``number, sequence_id, length`` of pieces -> their new places, where these are fewer sequences: ``number, to, place``."""
    groups = -(-tails.count() // GROUP) or 1

    def repack(part: pa.Table) -> pa.Table:
        length, number = part.column("length").to_pylist(), part.column("number").to_pylist()
        free = sorted(set(part.column("sequence_id").to_pylist()))
        packer, at = Packer(size), [(0, 0)] * len(length)
        for i in sorted(range(len(length)), key=lambda i: (-length[i], number[i])):
            at[i] = packer.place(length[i])
        if packer.made >= len(free):
            number, at = [], []
        return pa.table({"number": pa.array(number, pa.int64()), "to": pa.array([free[s] for s, _ in at], pa.int64()), "place": pa.array([o for _, o in at], pa.int64())})

    dealt = tails.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(repack, "number bigint, to bigint, place bigint")


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, ids: bool = True) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, sequence_id, offset``, and ``ids`` or ``ids_crc32``.

    A document is its text's ids and then END; null and empty texts are END alone. Longer ones are
    cut every ``size`` ids. ``ids``: the piece's ids as little-endian unsigned 32-bit numbers; without, their CRC32.
    Repeated rows and null ids are packed like any other; an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    first = written(_by_task(docs, str(vocabulary), size, ids), "packed")
    open_ = first.where((F.col("number").isNull()) & (F.col("start") >= TAIL)).select("sequence_id")
    made = first.where("number is not null")
    tails = cut(made.select("number", "sequence_id", "length").join(open_, "sequence_id", "left_semi"))
    moved = made.join(cut(_again(tails, size)), "number", "left")
    return moved.select(
        "doc_id", "piece", "start", "length", F.coalesce("to", "sequence_id").alias("sequence_id"), F.coalesce("place", "offset").alias("offset"),
        "ids" if ids else "ids_crc32",
    )


def pack_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces with a checksum in place of their ids; null, repeated and empty input as in :func:`pack`."""
    return pack(docs, vocabulary, ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
