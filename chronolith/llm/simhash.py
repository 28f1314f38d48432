"""SimHash near-duplicates with BK-trees.

Fingerprints are split into blocks so that any two within the radius agree on some choice of
blocks (the pigeonhole principle); each choice and its bits name a *shard*. Every shard gets a
BK-tree and its own members search it, following only the edges within the radius. The trees are
built where the shard's rows are, so nothing that grows with the data is broadcast. A shard
with more members than ``SHARD`` is cut into parts, and every two parts meet in a task of their own.
Each task returns a spanning forest of the links it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.bktree import Forest, labels_of, least_forest
from chronolith.llm.common import ALNUM_TABLE, cut, dropped, free_name, lean, pieces, ship, utf8, written
from chronolith.llm.graph import by_hub, components

BITS, RADIUS = 64, 4
#: Members of a shard's part; two parts at most meet in one step of a task.
SHARD = 1024
#: Expected members of a shard beyond which more blocks are used.
EXPECTED = 64
#: Members of a part where texts are compared.
LATE = 256
#: Rows of a few numbers each that are sent to all executors, at most; more are dealt out by key.
FEW = 500_000
#: Near-duplicate groups: independent fingerprints of a document, and the least cosine of five-word shingle sets.
PRINTS, SHINGLE, SIMILAR = 6, 5, 0.8
#: Segments of a text that are compared whole: so many, of so many words on average and at least.
SEGMENTS, SEGMENT_WORDS, SEGMENT_LEAST = 6, 16, 6
#: Members of a part of a segment's texts; members up to which all pairs of a part are weighed at first; neighbours weighed beyond.
SEGMENT_PART, SEGMENT_ALL, NEIGHBOURS = 4096, 64, 4
#: Bits of the map of a text's shingle set.
MAP = 2048


def shingle_hashes(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every ``size``-word shingle, repeats included, in bounded pieces.

    Words are runs of bytes other than ASCII white space, A-Z lowered. A text with fewer words
    is one shingle; null, empty and blank texts have none.
    """
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, 500_000):
        stop = min(at + 500_000, len(words) - size + 1)
        yield np.array(
            [digest(joined[s:e], 42) for s, e in zip(starts[at:stop], ends[at + size - 1 : stop + size - 1])],
            np.uint64,
        )


def fingerprint(text: bytes | None, size: int) -> int:
    """The SimHash: a bit is 1 if set in over half the shingles' hashes; 0 where there are none."""
    ones, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int32)
        total += len(h)
    bits = np.packbits(ones * 2 > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the signed 64-bit SimHash of each row's whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = pa.array([fingerprint(t, shingle) for t in utf8(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["doc_id", "fp"])

    return rows.mapInArrow(lean(scan), f"doc_id {kind}, fp bigint")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Signed bit masks: fingerprints within the radius are equal under at least one.

    The more fingerprints, the more bits a mask keeps, so that a shard keeps about the same size.
    """
    for blocks in range(radius + 1, 13):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        kept = blocks - radius
        if n / 2.0 ** (kept * BITS // blocks) <= EXPECTED:
            break
    out = []
    for choice in combinations(range(blocks), kept):
        m = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _meetings(rows: DataFrame, radius: int, n: int, part: int = SHARD, place: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(node, fp, f, ...)`` -> the same with their shards and the parts of ``part`` members that meet, ordered for a scan.

    A shard's rows come in the order of their nodes, so that ties fall alike in all shards and in
    repeated tasks. ``place`` may name ``f`` and ``t``, the fingerprint and the mask of a shard.
    """
    kept = [c for c in rows.columns if c not in ("fp", "f")]
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(n, radius)))))
    dealt = rows.select("fp", "f", *kept, keys.alias("k")).select("fp", "f", *kept, "k.t", "k.key")
    return _parted(dealt, ["f", "t", "key"], part, ["fp", *kept, *place])


def _parted(dealt: DataFrame, key: list[str], part: int, columns: list[str]) -> DataFrame:
    """The columns with ``shard`` for a key and the two parts of it that meet; a ``tree`` row meets those that ``asks``."""
    big = dealt.groupBy(*key).count().where(F.col("count") > part)
    big = cut(big.select(*key, F.ceil(F.col("count") / part).cast("int").alias("parts")))
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", key[0]), F.col("parts"))).otherwise(0).cast("int")
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    met = dealt.join(big, key, "left").withColumn("own", own).withColumn("other", other)
    met = met.select(
        F.xxhash64(*key, F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
        *columns,
        (F.col("own") <= F.col("other")).alias("tree"),
        (F.col("own") >= F.col("other")).alias("asks"),
    )
    return met.repartition("shard").sortWithinPartitions("shard", "node")


def _whole_shards(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.Table]:
    """The rows of a sorted partition in pieces that end where a shard ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table.column("shard").to_numpy()
            end = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if end:
                yield table.slice(0, end)
            held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounded(tables: Iterator[pa.Table], pairs: int = 1 << 21) -> Iterator[pa.Table]:
    """The same in slices whose shards can have about so many pairs in all; a shard with more is a slice."""
    for table in tables:
        if not table.num_rows:
            continue
        shard = table.column("shard").to_numpy()
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        low, total = 0, 0
        for at, end in zip(edges.tolist(), edges[1:].tolist()):
            if total and total + (end - at) ** 2 > pairs:
                yield table.slice(low, at - low).combine_chunks()
                low, total = at, 0
            total += (end - at) ** 2
        if total:
            yield table.slice(low).combine_chunks()


def _links_in(table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    fp, shard = table.column("fp").to_numpy().view(np.uint64), table.column("shard").to_numpy()
    tree, asks = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("tree", "asks"))
    q, e = Forest(fp[tree], shard[tree]).search(fp[asks], shard[asks], radius)
    a, b = asks[q], tree[e]
    keep = a != b
    return a[keep], b[keep]


def links(prints: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> links ``(u, v)`` that connect what lies within the radius.

    Each shard's links are replaced by a spanning forest, so the components are those of all
    links. A shard name is a hash; two shards under one name only meet needlessly.
    """
    rows = prints.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("f"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(_whole_shards(batches)):
            a, b = _links_in(table, radius)
            label, node = labels_of(table.num_rows, a, b), table.column("node").to_numpy()
            child = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["u", "v"])

    met = _meetings(rows, radius, prints.count() if n is None else n)
    return met.mapInArrow(lean(scan), "u bigint, v bigint").where("u <> v")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id whose fingerprint can be
    reached by links of at most ``radius`` differing bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows are kept as they come: repeated rows each give
    a row; a null id keeps its row and gets the component of its fingerprint (null if no member
    has an id). An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, id_column, text_column))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(nodes.select("fp"), radius))
    named = cut(nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("degree"))
    of = cut(by_hub(named, least, "root", named.count()).select("fp", "component_id"))
    return prints.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Groups of near copies by several fingerprints, with a check of the shingles.


def segments(words: list[bytes]) -> bytes:
    """Hashes of up to ``SEGMENTS`` segments of a text: those with the smallest.

    A segment ends where a word's hash says so, so a block put in or cut out changes no segment but those beside
    it, and texts alike but for such a block have most of their smallest in common.
    """
    seen: dict[bytes, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w, 7)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    ends = np.flatnonzero(h >> np.uint64(32) & np.uint64(SEGMENT_WORDS - 1) == 0)
    start = np.unique(np.r_[0, ends + 1])
    start = start[start < len(h)]
    if not len(start):
        return b""
    size = np.diff(np.r_[start, len(h)])
    place = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    whole = np.add.reduceat((h ^ place * np.uint64(0x9E3779B97F4A7C15)) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93)), start)
    found = np.unique(whole[size >= SEGMENT_LEAST])
    found ^= found >> np.uint64(29)
    return np.sort(found * np.uint64(0xBF58476D1CE4E5B9))[:SEGMENTS].astype(">u8").tobytes()


def content_prints(text: bytes | None) -> tuple[int, bytes, bytes]:
    """A hash of the word sequence, ``PRINTS`` SimHashes over the longer words, and the text's :func:`segments`.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered; words
    of three bytes or fewer, alike in all texts, carry no weight unless there are no others.
    """
    words = text.translate(ALNUM_TABLE).split() if text else []
    node = xxhash.xxh64_intdigest(b" ".join(words), 0)
    node = node - (1 << 64) if node >> 63 else node
    heavy = [w for w in words if len(w) > 3] or words
    if not heavy:
        return node, bytes(8 * PRINTS), b""
    count: dict[bytes, int] = {}
    for w in heavy:
        count[w] = count.get(w, 0) + 1
    weight = np.sqrt(np.fromiter(count.values(), np.float32, len(count)))
    total, sums = float(weight.sum()), np.zeros(64 * PRINTS)
    each = list(count)
    for at in range(0, len(each), 20_000):
        raw = b"".join(xxhash.xxh3_128_digest(w, s) for w in each[at : at + 20_000] for s in range(PRINTS // 2))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * PRINTS), axis=1)
        sums += weight[at : at + 20_000] @ bits
    return node, np.packbits(sums * 2 > total).tobytes(), segments(words)


def _few(rows: DataFrame) -> DataFrame:
    """Checkpointed rows, to be broadcast if they are at most FEW: then texts that have no part in a join stay where they are."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _packed(text: bytes | None) -> bytes | None:
    return None if text is None else zstandard.compress(text, 1)


def _unpacked(text: bytes | None) -> bytes | None:
    return None if text is None else zstandard.decompress(text)


def _each_print(signed: DataFrame) -> DataFrame:
    """A row for each of a signature's fingerprints."""
    one = F.explode(F.sequence(F.lit(0), F.lit(PRINTS - 1)))
    return signed.withColumn("f", one).withColumn(
        "fp", F.conv(F.hex(F.substring("sig", F.col("f") * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    )


def _pairs(signed: DataFrame, radius: int) -> DataFrame:
    """``(node, sig)`` -> candidate pairs: a least spanning forest of each shard's links.

    By the distance of all fingerprints together. What the forest leaves out is looked at by :func:`_late_links`.
    """
    rows = _each_print(signed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(_whole_shards(batches, 8192)):
            a, b = _links_in(table, radius)
            node = table.column("node").to_numpy()
            a, b = (x[node[a] != node[b]] for x in (np.minimum(a, b), np.maximum(a, b)))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, PRINTS)
            keep = least_forest(table.num_rows, a, b, _distances(sig, a, b))
            u, v = node[a[keep]], node[b[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    met = _meetings(rows.select("node", "fp", "f", "sig"), radius, signed.count())
    return met.mapInArrow(lean(scan), "u bigint, v bigint")


def _distances(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all fingerprints together, for pairs of rows."""
    return np.concatenate([np.bitwise_count(sig[a[i : i + 65536]] ^ sig[b[i : i + 65536]]).sum(1, np.int64) for i in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])


def _each_segment(rows: DataFrame) -> DataFrame:
    """``(segs, ...)`` -> a row with ``seg`` for each of a text's segments."""
    one = F.explode(F.sequence(F.lit(1), F.floor(F.length("segs") / 8)))
    seg = F.conv(F.hex(F.substring("segs", (F.col("i") - 1).cast("int") * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    return rows.where(F.length("segs") > 0).withColumn("i", one).withColumn("seg", seg).drop("segs", "i")


def _segment_pairs(signed: DataFrame) -> DataFrame:
    """``(node, sig, segs, size)`` -> candidate pairs of texts that have a segment in common.

    A spanning tree of each segment's texts, least of all their pairs where they are few, else of those with
    the next in size, so that a segment in very many texts gives a few pairs for each. Such texts go in parts, and
    one of them is in every part, which joins the trees. What a tree leaves out is looked at by :func:`_late_segment_links`.
    """
    rows = _each_segment(signed)
    count = cut(rows.groupBy("seg").agg(F.count("*").alias("count"), F.min("node").alias("first")).where("count > 1"))
    count = count.select("seg", "first", F.ceil(F.col("count") / SEGMENT_PART).alias("parts"))
    part = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    met = rows.join(count, "seg").withColumn("part", F.explode(part)).withColumn("shard", F.xxhash64("seg", "part"))
    met = met.select("shard", "seg", "size", "node", "sig").repartition("shard").sortWithinPartitions("shard", "seg", "size", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches, 8192):
            shard, node = table.column("shard").to_numpy(), table.column("node").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, PRINTS)
            start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            size = np.diff(np.r_[start, len(shard)])
            # pairs by how far apart they stand: all of small groups, next neighbours of large ones
            left = np.repeat(np.where(size <= SEGMENT_ALL, size, NEIGHBOURS + 1), size) - 1
            room = np.repeat(start + size, size) - np.arange(len(shard)) - 1
            pairs = [(at, at + k) for k in range(1, SEGMENT_ALL) if len(at := np.flatnonzero((left >= k) & (room >= k)))]
            a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
            keep = least_forest(table.num_rows, a, b, _distances(sig, a, b))
            u, v = node[a[keep]], node[b[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return met.mapInArrow(lean(scan), "u bigint, v bigint").where("u <> v")


def _shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    got = list(shingle_hashes(text.translate(ALNUM_TABLE) if text else None, SHINGLE))
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a cosine of at least ``SIMILAR``."""
    least = SIMILAR * (len(a) * len(b)) ** 0.5
    if not 0 < least <= min(len(a), len(b)):
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _late_links(open_nodes: DataFrame, texts: DataFrame, radius: int) -> DataFrame:
    """``(node, sig, label)`` -> links ``(u, v)`` that hold between nodes of different labels.

    Every candidate pair of two labels is compared once, in the first shard that both are in, but
    none is emitted: a first scan names the members of a shard that have such a candidate, a row
    each; their texts are brought there, and one task compares the pairs and returns a forest. A
    task holds the texts of two parts.
    """
    n = open_nodes.count()
    kept_bits = np.array(masks(n, radius), np.int64).view(np.uint64)

    def between(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        a, b = _links_in(table, radius)
        label, f, t = (table.column(c).to_numpy() for c in ("label", "f", "t"))
        keep = (label[a] != label[b]) & (f[a] == f[b]) & (t[a] == t[b])
        a, b = a[keep], b[keep]
        fp = table.column("fp").to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, PRINTS)
        own = [np.zeros(0, bool)]
        for at in range(0, len(a), 8192):
            p, q = a[at : at + 8192], b[at : at + 8192]
            near = np.bitwise_count(sig[p] ^ sig[q]) <= radius
            same = ((fp[p] ^ fp[q])[:, None] & kept_bits) == 0
            own.append((near.argmax(1) == f[p]) & (same.argmax(1) == t[p]) & same.any(1))
        keep = np.concatenate(own)
        return a[keep], b[keep]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(_whole_shards(batches, 8192)):
            ends = np.unique(np.concatenate(between(table)))
            yield from table.take(pa.array(ends)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches, 1):
            shard = table.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for low, high in zip(edges, edges[1:]):
                yield _compared(table.slice(low, high - low).combine_chunks(), between)

    members = _meetings(_each_print(open_nodes).select("node", "fp", "f", "label", "sig"), radius, n, LATE, ("f", "t"))
    named = cut(members.select("shard", "fp", "node", "label", "sig", "f", "t", "tree", "asks").mapInArrow(
        lean(name), "shard bigint, fp bigint, node bigint, label bigint, sig binary, f int, t int, tree boolean, asks boolean"
    ))
    some = texts.select("node", "text").join(_few(cut(named.select("node").distinct())), "node", "left_semi")
    told = named.join(some, "node").repartition("shard").sortWithinPartitions("shard", "node")
    return told.select(*named.columns, "text").mapInArrow(lean(compare), "u bigint, v bigint")


def _shingle_map(shingles: np.ndarray) -> bytes:
    """A bit for each of ``MAP`` classes of hashes, set where the set has one."""
    held = np.zeros(MAP, bool)
    held[(shingles & np.uint64(MAP - 1)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def _may_be_similar(table: pa.Table, pairs: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(shard, n, bits, label, tree, asks)`` -> the pairs that meet, have two labels and can have a cosine of ``SIMILAR``.

    No such pair is lost: sizes bound the cosine, and every bit that one map has and the other has not stands for
    a shingle which the other has not.
    """
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shard, n, label = (table.column(c).to_numpy() for c in ("shard", "n", "label"))
    tree, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "asks"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, MAP // 64)
    rest = n - np.bitwise_count(bits).sum(1, np.int64)
    order = np.lexsort((n, shard))
    run = np.cumsum(np.r_[False, shard[order][1:] != shard[order][:-1]]) << 40
    # in the order of sizes a row meets those behind it, up to the largest that its own allows
    end = np.searchsorted(run + n[order], run + (n[order] / SIMILAR**2 + 1).astype(np.int64), side="right")
    count = end - np.arange(len(order)) - 1
    total, found = np.cumsum(count), []
    for low in range(0, int(total[-1]), pairs):
        k = np.arange(low, min(low + pairs, int(total[-1])))
        at = np.searchsorted(total, k, side="right")
        a, b = order[at], order[at + 1 + k - (total[at] - count[at])]
        keep = (label[a] != label[b]) & (tree[a] & asks[b] | tree[b] & asks[a])
        a, b = a[keep], b[keep]
        both = np.bitwise_count(bits[a] & bits[b]).sum(1, np.int64)
        keep = both + np.minimum(rest[a], rest[b]) >= SIMILAR * np.sqrt(n[a] * n[b]) - 1e-6
        found.append((a[keep], b[keep]))
    return tuple(np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _late_segment_links(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, segs, label)`` -> links ``(u, v)`` that hold between nodes of different labels that have a segment in common.

    All pairs of a segment's nodes are weighed by the sizes and maps of their shingle sets, in parts that meet pairwise; none is
    emitted, but the nodes that have a partner left. These meet again in smaller parts, with their texts, which are compared.
    """
    rows = _each_segment(open_nodes.select("node", "label", "segs"))
    mixed = rows.groupBy("seg").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = cut(rows.join(mixed.select("seg"), "seg").select("seg", "node", "label"))

    def with_texts(of: DataFrame) -> DataFrame:
        return texts.select("node", "text").join(_few(cut(of.select("node").distinct())), "node", "left_semi")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            sets = [_shingle_set(_unpacked(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_shingle_map(x) for x in sets], pa.binary())], names=["node", "n", "bits"]
            )

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(_whole_shards(batches, 8192)):
            ends = np.unique(np.concatenate(_may_be_similar(table)))
            yield from table.take(pa.array(ends)).select(columns).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches, 1):
            shard = table.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for low, high in zip(edges, edges[1:]):
                yield _compared(table.slice(low, high - low).combine_chunks(), _may_be_similar)

    columns = ["seg", "node", "label", "n", "bits"]
    maps = with_texts(rows).mapInArrow(lean(sketch), "node bigint, n bigint, bits binary")
    met = _parted(cut(rows.join(maps, "node").select(*columns)), ["seg"], SHARD, columns)
    named = cut(met.mapInArrow(lean(name), "seg bigint, node bigint, label bigint, n bigint, bits binary").distinct())
    met = _parted(named, ["seg"], LATE, columns)
    told = met.join(with_texts(named), "node").repartition("shard").sortWithinPartitions("shard", "node")
    return told.select(*met.columns, "text").mapInArrow(lean(compare), "u bigint, v bigint")


def _compared(table: pa.Table, between) -> pa.RecordBatch:
    """One shard's links that hold, but those between nodes already connected here."""
    node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
    sets = [_shingle_set(_unpacked(t)) for t in table.column("text").to_pylist()]
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    u, v = [], []
    for a, b in zip(*(x.tolist() for x in between(table))):
        p, q = find(int(label[a])), find(int(label[b]))
        if p != q and _similar(sets[a], sets[b]):
            root[p] = q
            u.append(int(node[a]))
            v.append(int(node[b]))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, root)`` of word sequences: texts whose five-word shingle sets have a cosine of 0.8 or more, and what they reach.

    Candidates come from ``PRINTS`` SimHashes searched through BK-trees, and from whole segments in common. The shingles of a spanning
    forest of them are compared first, which joins nearly all copies; then those of every candidate
    pair, of either kind, whose ends are still apart. ``node`` is the hash from :func:`content_prints`; roots are left out. Null and empty texts
    have one node. Repeated rows are one node; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = utf8(b.column(0))
            node, sig, segs = zip(*map(content_prints, texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(segs, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([_packed(t) for t in texts], pa.binary())],
                names=["node", "sig", "segs", "size", "text"],
            )

    signed = rows.mapInArrow(lean(scan), "node bigint, sig binary, segs binary, size bigint, text binary")
    # one text, compressed, for each word sequence: copies in a third of all rows meet as partial results
    first = F.min_by(F.struct("sig", "segs", "size", "text"), "size").alias("x")
    kept = written(signed.groupBy("node").agg(first).select("node", "x.*"), "prints")
    pairs = cut(_pairs(kept.select("node", "sig"), radius).union(_segment_pairs(kept.select("node", "sig", "segs", "size"))).distinct())
    left = kept.select(F.col("node").alias("u"), F.col("text").alias("a")).join(_few(pairs), "u")
    ends = _few(cut(pairs.select("v").distinct()))
    both = left.join(kept.select(F.col("node").alias("v"), F.col("text").alias("b")).join(ends, "v", "left_semi"), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            # a node of many pairs is hashed once for each piece
            sets: dict[int, np.ndarray] = {}
            for ids, texts in ((0, 2), (1, 3)):
                for node, text in zip(b.column(ids).to_pylist(), b.column(texts).to_pylist()):
                    if node not in sets:
                        sets[node] = _shingle_set(_unpacked(text))
            same = [_similar(sets[u], sets[v]) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], names=["u", "v", "same"])

    tested = cut(both.select("u", "v", "a", "b").mapInArrow(lean(verify), "u bigint, v bigint, same boolean"))
    root = components(tested.where("same").select("u", "v"))

    # A candidate pair left out of a forest joins two labels only if each has an end of a failed pair.
    def label(end: str) -> DataFrame:
        return root.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))

    failed = tested.where("not same").join(label("u"), "u", "left").join(label("v"), "v", "left")
    failed = failed.select(F.coalesce("of_u", "u").alias("a"), F.coalesce("of_v", "v").alias("b")).where("a <> b")
    unsettled = failed.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    named = kept.select("node", "sig", "segs").join(root, "node", "left").select("node", "sig", "segs", F.coalesce("root", "node").alias("label"))
    open_nodes = cut(named.join(unsettled, "label", "left_semi"))
    late = _late_links(open_nodes.drop("segs"), kept, radius).union(_late_segment_links(open_nodes, kept))
    out = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).union(late))
    dropped(kept)  # what comes out is checkpointed
    return out


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, then the smallest text.

    All columns stay. Repeated rows count as copies of each other; null and empty texts are
    copies of each other; a null id comes after all others.
    """
    root = near_duplicate_groups(docs)
    key_, id_, n_ = (free_name(c, docs.columns) for c in ("__key", "__id", "__n"))
    rows = docs.select("doc_id", F.xxhash64(*docs.columns).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [xxhash.xxh64_intdigest(b" ".join((t or b"").translate(ALNUM_TABLE).split()), 0) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "key", "node"])

    # the best row of each word sequence, then of each group; ranks carry no text
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key").alias("rank")
    marked = rows.mapInArrow(lean(scan), f"doc_id {kind}, key bigint, node bigint").select("node", rank)
    best = marked.groupBy("node", "rank").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct("rank", "n")).alias("best"))
    named = best.join(root, "node", "left")
    chosen = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    chosen = cut(chosen.select(F.col("best.rank.key").alias(key_), F.col("best.rank.id").alias(id_), F.col("best.n").alias(n_)))
    only = docs.withColumn(key_, F.xxhash64(*docs.columns)).join(_few(chosen), key_).where(F.col("doc_id").eqNullSafe(F.col(id_)))
    if chosen.where(F.col(n_) > 1).isEmpty():
        return only.select(*docs.columns)
    # rows alike in every column are copies too: one of them stays
    many = only.where(F.col(n_) > 1).select(*docs.columns, key_).dropDuplicates([*(c for c in docs.columns if c != "text"), key_])
    return only.where(F.col(n_) == 1).select(*docs.columns).unionByName(many.select(*docs.columns))
