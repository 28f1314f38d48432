"""Language-model scores by Stupid Backoff over n-grams of words, counted over the whole corpus.

The relations are the usual ones: the n-grams of every text, exploded; a count table partitioned by their hash;
a join that gives each n-gram its count; a sum for each text. Their rows are packed. Texts are dealt into
blocks by hash. A block explodes into its distinct n-grams and their counts, one row for each bucket of
hashes, so an n-gram in every text is one number for each block. A bucket is the part of the count table with
its hashes: it adds the counts up and sends each block the totals of its n-grams, in their order. Back
in its block a text's words are scored and summed.

Blocks are a quarter of the buckets at most; their size grows with the square root of the corpus once it is large, so that a
row keeps some tens of n-grams at least and the packed rows stay in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import give_back, lean, ship, utf8

BACKOFF, WORD_ORDER, START = 0.4, 3, 2
#: Bytes of text of a block and of a bucket's share, at least; n-grams of a block's share of a packed row; bytes that a task deals at once.
WORD_BYTES, ROW_KEYS, DEAL_BYTES = 4_000_000, 256, 16_000_000
#: Characters of scripts written without blanks (Thai to Burmese, and from the CJK radicals on) are words each.
_SINGLE = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e-\x9f][\x80-\xbf]|[\xe3-\xed\xef][\x80-\xbf]{2}|\xe2[\xba-\xbf][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")


class _Hashes(dict):
    """Words -> XXH64, filled in as words are met."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lowered; characters of scripts without blanks one by one."""
    text = (text or b"").lower()
    return (text if text.isascii() else _SINGLE.sub(rb" \g<0> ", text)).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def key_bits(n: int) -> int:
    """Bits of a key of one of n n-grams: so many that less than one clash is to be expected among all, 64 at most."""
    return min(64, max(32, 2 * max(n, 1).bit_length()))


def _keyed(texts: list[bytes | None], order: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A block's tokens: their text, whether a word, the key of the k-gram that ends at each, and whether that is one.

    A text with words is led by ``order - 1`` start marks, and the k-grams of marks alone are counted once a
    text, as contexts; ``order`` 1 needs no marks.
    """
    seen = _Hashes()
    # one text's words at a time, as lists of them are large
    found = [np.fromiter(map(seen.__getitem__, words_of(t)), np.uint64) for t in texts]
    lead = order - 1
    sizes = np.array([len(w) + lead if len(w) else 0 for w in found], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(text)) - start
    word = at >= lead
    token = np.zeros(len(text), np.uint64)
    token[word] = np.concatenate(found)
    token[~word] = START
    keys, valid = [], []
    key, drop = _mixed(token + np.uint64(1)), np.uint64(64 - bits)
    for k in range(1, order + 1):
        if k > 1:
            before = np.r_[np.zeros(min(1, len(key)), np.uint64), key[:-1]]
            key = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(k))
        keys.append(key >> drop)
        valid.append(word | ((at == lead - 1) & (k < order)))
    return text, word, keys, valid


def _table(keys: list[np.ndarray], valid: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys in order and their counts; key 0 counts the words."""
    got = np.concatenate([k[v] for k, v in zip(keys, valid)])
    got.sort()
    new = np.flatnonzero(np.r_[True, got[1:] != got[:-1]]) if len(got) else np.zeros(0, np.int64)
    return np.r_[np.uint64(0), got[new]], np.r_[np.int64(word.sum()), np.diff(np.r_[new, len(got)])]


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes and so on, without the leading bytes that all lack."""
    wide = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    wide = len(x) // max(n, 1)
    out[:, :wide] = np.frombuffer(x, np.uint8).reshape(wide, n).T
    return out.reshape(-1).view(np.uint64)


def _marked(x: np.ndarray, usual: np.ndarray | int) -> tuple[bytes, bytes]:
    """Numbers that mostly are what is usual: a bit for each, and those that are not."""
    other = x != usual
    return np.packbits(other).tobytes(), _packed(x[other])


def _unmarked(bits: bytes, others: bytes, usual: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(usual)))
    out = usual.copy()
    out[at] = _unpacked(others, len(at)).view(np.int64)
    return out


def _block_scores(ids: pa.Array, texts: list[bytes | None], told: pa.Table, order: int, bits: int) -> pa.Table:
    """The sums of one block's texts, from the corpus' counts of the block's keys."""
    text, word, keys, valid = _keyed(texts, order, bits)
    every = np.concatenate([k[v] for k, v in zip(keys, valid)])
    of = np.concatenate([text[v] for v in valid]).astype(np.int32)
    del keys
    # large arrays are dropped as soon as they have served: a long text is a block by itself
    sort = np.argsort(every)
    every = every[sort]
    new = np.r_[True, every[1:] != every[:-1]][: len(every)]
    counts = np.diff(np.r_[np.flatnonzero(new), len(every)])
    rank = np.empty(len(every), np.int32)
    rank[sort] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del every, sort, new
    total = np.r_[np.int64(word.sum()), counts]
    at = 0
    for size, mark, others in zip(*(told.column(c).to_pylist() for c in ("size", "mark", "total"))):
        total[at : at + size] = _unmarked(mark, others, total[at : at + size])
        at += size
    # the occurrences of a key in one text, made neighbours
    pair = rank.astype(np.int64) * len(texts) + of
    sort = np.argsort(pair)
    pair = pair[sort]
    runs = np.diff(np.r_[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)]), len(pair)]).astype(np.int32)
    del pair, of
    own = np.empty(len(sort), np.int32)
    own[sort] = np.repeat(runs, runs)
    del sort, runs
    # how often the k-gram that ends at a token occurs outside of its text
    left = total[1:][rank] - own
    del rank, own
    others = []
    for v in valid:
        others.append(np.zeros(len(text), np.int64))
        size = int(v.sum())
        others[-1][v], left = left[:size], left[size:]
    n = np.bincount(text[word], minlength=len(texts)).astype(np.int64)
    rest = np.maximum(total[0] - n[text], 1)
    score = np.where(others[0] > 0, others[0], BACKOFF) / rest
    for k in range(1, order):
        context = np.r_[np.zeros(min(1, len(text)), np.int64), others[k - 1][:-1]]
        score = np.where(others[k] > 0, others[k] / np.maximum(context, 1), BACKOFF * score)
    log = np.bincount(text[word], np.log(score[word]), len(texts))
    mean = pa.array(np.round(log / np.maximum(n, 1), 9), mask=n == 0)
    return pa.Table.from_arrays([ids, pa.array(n), pa.array(np.round(log, 6)), mean], names=["doc_id", "n_grams", "log_prob", "mean_log_prob"])


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """``block, ids, sizes, texts``: the rows of each block that a task meets, in one row, their texts compressed."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)

        def packed(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("block").combine_chunks()
            block = table.column("block").to_numpy()
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            ids, texts = table.column("doc_id").combine_chunks(), utf8(table.column("text").combine_chunks())
            sizes = pa.array([-1 if t is None else len(t) for t in texts], pa.int32())
            cuts = pa.array(edges, pa.int32())
            raw = [packer.compress(b"".join([t for t in texts[a:b] if t])) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(block[edges[:-1]]), pa.ListArray.from_arrays(cuts, ids), pa.ListArray.from_arrays(cuts, sizes), pa.array(raw, pa.binary())],
                names=["block", "ids", "sizes", "texts"],
            )

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= DEAL_BYTES:
                yield packed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(lean(scan), f"block bigint, ids array<{kind}>, sizes array<int>, texts binary")


def _texts(block: pa.Table) -> list[bytes | None]:
    out, unpacker = [], zstandard.ZstdDecompressor()
    for sizes, raw in zip(block.column("sizes").to_pylist(), block.column("texts").to_pylist()):
        whole, at = unpacker.decompress(raw), 0
        for n in sizes:
            out.append(None if n < 0 else whole[at : at + n])
            at += max(n, 0)
    return out


def word_scores(docs: DataFrame, order: int = WORD_ORDER) -> DataFrame:
    """``doc_id, n_grams, log_prob, mean_log_prob`` of every whole text, under the counts of all other rows of docs.

    A word's score is the count of its ``order``-gram by its context's, both outside of the text; where
    the n-gram is nowhere else, ``BACKOFF`` times the score of the n-gram one shorter, down to the word's share, and
    for a word found nowhere else ``BACKOFF`` by the number of words. log_prob: the sum of the natural
    logarithms over the text's words; mean: by their number, null for texts without any (null, empty and blank ones), whose
    sum is 0. Repeated rows each count and each give a row; an empty table gives none. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    # nearly the number of words, which only the keys' size depends on
    blanks = F.octet_length("text") - F.octet_length(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    size, words = rows.agg(F.sum(F.octet_length("text")), F.sum(blanks)).first()
    size, words = size or 0, words or 0
    count = max(1, size // max(WORD_BYTES, int((2 * ROW_KEYS * size) ** 0.5)))
    fine = (4 * count).bit_length() - 1  # buckets by so many leading bits: several for a block, so that tasks get like shares
    bits = key_bits(order * words)
    blocks = _dealt(rows, count)

    def send(block: pa.Table) -> pa.Table:
        _, word, keys, valid = _keyed(_texts(block), order, bits)
        key, n = _table(keys, valid, word)
        del keys, valid, word
        first = np.arange(1 << fine, dtype=np.uint64) << np.uint64(bits - fine) if fine else np.zeros(1, np.uint64)
        edges = np.r_[np.searchsorted(key, first), len(key)].tolist()
        held = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        cuts = [(a, b) for _, a, b in held]
        marks = [_marked(n[a:b], 1) for a, b in cuts]
        out = pa.Table.from_arrays(
            [pa.array([k for k, _, _ in held], pa.int64()), pa.repeat(block.column("block")[0], len(cuts)), pa.array([b - a for a, b in cuts], pa.int64()),
             pa.array([_packed(np.diff(key[a:b], prepend=first[k])) for k, a, b in held], pa.binary()), pa.array([m for m, _ in marks], pa.binary()), pa.array([o for _, o in marks], pa.binary())],
            names=["bucket", "block", "size", "keys", "mark", "n"],
        )
        del key, n, marks, held
        give_back()
        return out

    def add(part: pa.Table) -> pa.Table:
        sizes = part.column("size").to_pylist()
        keys = [np.cumsum(_unpacked(x, k), dtype=np.uint64) for x, k in zip(part.column("keys").to_pylist(), sizes)]
        n = np.concatenate([_unmarked(m, x, np.ones(k, np.int64)) for m, x, k in zip(part.column("mark").to_pylist(), part.column("n").to_pylist(), sizes)])
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, n, len(every)).astype(np.int64)[of]  # whole numbers far below 2**53
        cuts = np.cumsum([0, *sizes])
        marks = [_marked(total[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
        out = pa.Table.from_arrays(
            [part.column("block"), part.column("bucket"), part.column("size"), pa.array([m for m, _ in marks], pa.binary()), pa.array([o for _, o in marks], pa.binary())],
            names=["to", "bucket", "size", "mark", "total"],
        )
        del keys, n, every, of, total, marks
        give_back()
        return out

    def sums(block: pa.Table, told: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([c.flatten() for c in block.column("ids").chunks])
        out = _block_scores(ids, _texts(block), told.sort_by("bucket"), order, bits)
        give_back()
        return out

    # both uses of the blocks read the one exchange that deals them
    sent = blocks.groupBy("block").applyInArrow(send, "bucket bigint, block bigint, size bigint, keys binary, mark binary, n binary")
    told = sent.groupBy("bucket").applyInArrow(add, "to bigint, bucket bigint, size bigint, mark binary, total binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(told.groupBy("to"))
    return out.applyInArrow(sums, f"doc_id {kind}, n_grams bigint, log_prob double, mean_log_prob double")


def oracle() -> str:
    """DuckDB SQL for word_scores of three words over documents, whose scripts all have blanks."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    gram = "CASE k WHEN 1 THEN c WHEN 2 THEN b || ' ' || c ELSE a || ' ' || b || ' ' || c END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
t AS (SELECT r, unnest(list_concat([chr(2), chr(2)], w)) AS x, generate_subscripts(list_concat([chr(2), chr(2)], w), 1) AS i FROM d WHERE len(w) > 0),
g AS (SELECT r, i, x AS c, lag(x) OVER o AS b, lag(x, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
e AS (SELECT r, i, k, {gram} AS s FROM g, (VALUES (1), (2), (3)) AS v(k) WHERE i > 2 OR (i = 2 AND k < 3)),
own AS (SELECT r, k, s, count(*) AS m FROM e GROUP BY ALL),
tot AS (SELECT k, s, sum(m) AS n FROM own GROUP BY ALL),
rest AS (SELECT own.r, own.k, own.s, tot.n - own.m AS n FROM own JOIN tot USING (k, s)),
seen AS (SELECT e.r, e.i, e.k, rest.n FROM e JOIN rest USING (r, k, s)),
p AS (SELECT r, i, max(n) FILTER (k = 1) AS n1, max(n) FILTER (k = 2) AS n2, max(n) FILTER (k = 3) AS n3 FROM seen GROUP BY ALL),
q AS (SELECT *, lag(n1) OVER o AS m1, lag(n2) OVER o AS m2 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
whole AS (SELECT sum(len(w)) AS n FROM d),
z AS (SELECT q.r, CASE WHEN n3 > 0 THEN n3 / m2 WHEN n2 > 0 THEN {BACKOFF}::DOUBLE * (n2 / m1)
        ELSE {BACKOFF}::DOUBLE * {BACKOFF}::DOUBLE * (CASE WHEN n1 > 0 THEN n1 ELSE {BACKOFF}::DOUBLE END / greatest(whole.n - len(d.w), 1)) END AS score
      FROM q JOIN d ON q.r = d.r, whole WHERE i > 2),
l AS (SELECT r, sum(ln(score)) AS log_prob FROM z GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_grams, round(coalesce(log_prob, 0), 6) AS log_prob, CASE WHEN len(w) > 0 THEN round(log_prob / len(w), 9) END AS mean_log_prob
FROM d LEFT JOIN l USING (r)
"""
