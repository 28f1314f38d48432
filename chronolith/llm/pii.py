"""Personal data: spans by pattern, and more of them by bootstrapped contexts.

Base spans are seeds. So are key-shaped values that are assigned to a name, which may be secrets. The tokens around a
seed induce lexical patterns: three to its left, three to its right, or two and one. Patterns that many
distinct seeds have are looked for in all texts; whatever stands in a pattern's slot is an instance of it. Patterns and
instances form a graph that Spark scores in rounds: a pattern is as good as the mean of its instances, damped by their
number; an instance that is no seed is as good as the noisy-or of its patterns. Instances of high score that
look like an identifier are added to the spans, and count as seeds of the next generation's patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import cut, lean, pieces, ship, written

#: The four base kinds, and what contexts alone tell.
KINDS, SECRET = ("email", "ip", "card", "phone"), 4
NAMES = (*KINDS, "secret")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A hexadecimal key of 32 digits or more, assigned to a name.
KEY = re.compile(r"[=:]\s{0,4}[\"']?((?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,})(?![0-9a-z])")
#: What may fill a slot (in order of trial): an address with its signs spelled out, a number in groups, a run without blanks.
HIDDEN = re.compile(r"[a-z0-9._%+-]+ ?[\[(] ?at ?[\])] ?[a-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[a-z0-9-]+)+")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])*+(?![^\W_])")
RUN = re.compile(r"[^\s\"'<>,;]+")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
LIKE = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
ROUNDS, ACCEPT, DAMP, GENERATIONS = 3, 0.9, 0.5, 3
#: A pattern has so many distinct seeds at least, and at least this share of its kind's: so a kind has 3 / SHARE patterns at most,
#: on any amount of text, and what chance puts beside a seed now and then is none.
SUPPORT, SHARE = 5, 0.002
#: Bytes of patterns that are looked for in one scan of the texts.
BLOCK = 4_000_000


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @ that the match before has left, then a domain."""
    floor, at = 0, text.find("@")
    while at >= 0:
        if at >= floor and (domain := EMAIL_DOMAIN.match(text, at + 1)):
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                floor = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind by number, end) of the four kinds, in order; matches that fail their test are dropped."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def lowered(text: str) -> str:
    """The text in lower case, character for character."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def secrets(low: str) -> list[tuple[int, int, int]]:
    return [(m.start(1), SECRET, m.end(1)) for m in KEY.finditer(low)]


def _token(x: str) -> str:
    return "0" if x.isdigit() else x


def _before(low: str, end: int, n: int = 3) -> list[str]:
    """The n tokens before a place, whole; ``^`` where the text has none."""
    wide = 32
    while True:
        start = max(0, end - wide)
        got = TOKEN.findall(low, start, end)
        if len(got) > n or not start:
            return [*["^"] * (n - len(got)), *map(_token, got[-n:])]
        wide *= 2


def _after(low: str, start: int, n: int = 3) -> list[str]:
    out = []
    while len(out) < n and (m := TOKEN.search(low, start)):
        out.append(_token(m[0]))
        start = m.end()
    return out + ["$"] * (n - len(out))


def contexts(low: str, start: int, end: int) -> list[str]:
    """The patterns around a span: left (``<``), right (``>``) and both (``=``), each with a word in it."""
    left, right = _before(low, start), _after(low, end)
    made = ((left, "< " + " ".join(left)), (right, "> " + " ".join(right)), (left[1:], f"= {' '.join(left[1:])} {right[0]}"))
    return [name for tokens, name in made if any(x.isalpha() for x in tokens)]


class Matcher:
    """Finds the slots of patterns: each is looked for by its longest word, then compared as a whole."""

    def __init__(self, patterns: dict[str, list[int]]) -> None:
        self.patterns = patterns
        places: dict[str, set[tuple[bool, int]]] = {}
        for name in patterns:
            side, *tokens = name.split(" ")
            tokens = tokens[:2] if side == "=" else tokens
            at = max(range(len(tokens)), key=lambda i: (tokens[i].isalpha(), len(tokens[i])))
            # how many tokens lie between the word and the slot
            places.setdefault(tokens[at], set()).add((side != ">", at if side == ">" else len(tokens) - 1 - at))
        self.words = ahocorasick.Automaton()
        for word, where in places.items():
            self.words.add_word(word, (len(word), sorted(where)))
        self.words.make_automaton()

    def __call__(self, low: str) -> dict[tuple[int, int], list[str]]:
        """Spans in a slot, each with all its patterns."""
        found: dict[tuple[int, int], list[str]] = {}
        for last, (size, where) in self.words.iter(low) if self.patterns else ():
            start, end = last + 1 - size, last + 1
            if start and low[start - 1].isalpha() or end < len(low) and low[end].isalpha():
                continue
            for forward, skip in where:
                span = _slot_after(low, end, skip) if forward else _slot_before(low, start, skip)
                if span and span not in found:
                    around = contexts(low, *span)
                    if any(c in self.patterns for c in around):
                        found[span] = around
        return found


def _slot_after(low: str, at: int, skip: int) -> tuple[int, int] | None:
    for _ in range(skip):
        m = TOKEN.search(low, at)
        if not m:
            return None
        at = m.end()
    while at < len(low) and low[at].isspace():
        at += 1
    for shape in (HIDDEN, NUMBER, RUN):
        if m := shape.match(low, at):
            end = at + len(m[0].rstrip(".:!?)]}"))
            return (at, end) if end > at else None
    return None


def _slot_before(low: str, at: int, skip: int) -> tuple[int, int] | None:
    end = at
    for _ in range(skip):
        end = len(low[:end].rstrip()) if end and low[end - 1].isspace() else end
        if not end:
            return None
        if not low[end - 1].isalnum():
            end -= 1
            continue
        digit = low[end - 1].isdigit()
        while end and low[end - 1].isalnum() and low[end - 1].isdigit() == digit:
            end -= 1
    while end and low[end - 1].isspace():
        end -= 1
    start = end
    while start and not low[start - 1].isspace() and low[start - 1] not in "\"'<>,;([{":
        start -= 1
    return (start, end) if start < end else None


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _surface(low: str) -> str:
    return re.sub(r"[\s().-]", "", low)


MENTION = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("like", pa.bool_()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))]))
MENTIONS = "array<struct<start: bigint, kind: int, `end`: bigint, like: boolean, surface: string, patterns: array<string>>>"


def _mention(low: str, start: int, kind: int, end: int, patterns: list[str]) -> dict:
    part = low[start:end]
    return {"start": start, "kind": kind, "end": end, "like": LIKE.search(part) is not None, "surface": _surface(part), "patterns": patterns}


def _key() -> list[Column]:
    """Two hashes that name a row by its id and text; rows alike in both have the same spans."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.hash(F.col("text"), F.col("doc_id")).alias("b")]


def _seeds(docs: DataFrame) -> DataFrame:
    """``doc_id, a, b``, base counts, ``base`` and ``mentions`` of every row."""
    rows = docs.select("doc_id", "text", *_key())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            base, counts, mentions = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                digit = any(map(text.__contains__, "0123456789"))
                spans = base_spans(text) if digit or "@" in text else []
                keys = "=" in text or ":" in text
                low = lowered(text) if spans or digit and keys else ""
                more = secrets(low) if digit and keys else []
                base.append(_digest(spans))
                counts.append([sum(k == n for _, k, _ in spans) for n in range(4)])
                mentions.append([_mention(low, s, k, e, contexts(low, s, e)) for s, k, e in (*spans, *more)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), *(pa.array([c[n] for c in counts], pa.int64()) for n in range(4)), pa.array(base, pa.string()), pa.array(mentions, MENTION)],
                names=["doc_id", "a", "b", *(f"n_{k}" for k in KINDS), "base", "mentions"],
            )

    return written(rows.mapInArrow(lean(scan), f"doc_id {kind}, a bigint, b int, {', '.join(f'n_{k} bigint' for k in KINDS)}, base string, mentions {MENTIONS}"), "pii")


def _instances(docs: DataFrame, patterns: DataFrame) -> list[DataFrame]:
    """What fills the slots of ``(kind, pattern)`` in all texts: ``a, b, m`` with a mention for each kind.

    The patterns are looked for a block of ``BLOCK`` bytes after another, each in a scan of its own.
    """
    spark, out = docs.sparkSession, []
    size = patterns.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
    count = -(-size // BLOCK)
    rows = docs.where(F.length("text") > 0).select("text", *_key())
    for k in range(count):
        block: dict[str, list[int]] = {}
        for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(count)) == k).collect():
            block.setdefault(r["pattern"], []).append(r["kind"])
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            match = Matcher(sent.value)
            for b in pieces(batches):
                at, got = [], []
                for i, text in enumerate(b.column(0).to_pylist()):
                    low = lowered(text)
                    if not (found := match(low)):
                        continue
                    taken = [(s, e) for s, _, e in (*base_spans(text), *secrets(low))]
                    for (s, e), around in found.items():
                        if not any(s < y and x < e for x, y in taken):
                            for kind in sorted({kind for c in around for kind in match.patterns.get(c, ())}):
                                at.append(i)
                                got.append(_mention(low, s, kind, e, around))
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(1).take(place), b.column(2).take(place), pa.array(got, MENTION.value_type)], names=["a", "b", "m"])

        out.append(written(rows.mapInArrow(lean(scan), f"a bigint, b int, m {MENTIONS[6:-1]}"), "instances"))
        sent.unpersist()
    return out


def scored(graph: DataFrame) -> DataFrame:
    """``kind, surface, seed, score`` of the instances of a graph ``(kind, pattern, surface, seed)``, after ``ROUNDS`` rounds.

    Its patterns are few (:func:`_useful`) and are sent to all; instances meet by their strings.
    """
    graph = cut(graph.groupBy("kind", "pattern", "surface").agg(F.max("seed").alias("seed")))
    score = graph.groupBy("kind", "surface").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    for _ in range(ROUNDS):
        met = graph.select("kind", "pattern", "surface").join(score, ["kind", "surface"])
        pattern = met.groupBy("kind", "pattern").agg((F.sum("score") / (F.count("*") + DAMP)).alias("good"))
        reached = graph.join(F.broadcast(pattern), ["kind", "pattern"]).groupBy("kind", "surface").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("good"), F.lit(1e-9)))))).alias("found")
        )
        score = cut(reached.select("kind", "surface", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("score")))
    return score


def _useful(edges: DataFrame) -> DataFrame:
    """``kind, pattern`` with ``SUPPORT`` distinct seeds or more, and ``SHARE`` of the kind's; of bounded size."""
    edges = edges.distinct()
    every = edges.select("kind", "surface").distinct().groupBy("kind").agg(F.count("*").alias("every"))
    some = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n")).join(F.broadcast(every), "kind")
    return some.where((F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("every"))).select("kind", "pattern")


def _added(docs: DataFrame, mentions: DataFrame) -> DataFrame | None:
    """``a, b, start, kind, end`` of what contexts add; None where no pattern has seeds enough."""
    edges = mentions.select("kind", "surface", F.explode("patterns").alias("pattern"))
    known = cut(_useful(edges))
    if known.isEmpty():
        return None
    fresh, found, accepted = known, None, None
    for _ in range(GENERATIONS):
        for part in _instances(docs, fresh):
            part = part.select("a", "b", "m.*")
            found = part if found is None else found.union(part)
        seeds = edges.withColumn("seed", F.lit(True)).unionByName(
            found.select("kind", "surface", F.explode("patterns").alias("pattern")).withColumn("seed", F.lit(False))
        )
        score = scored(seeds.join(F.broadcast(known), ["kind", "pattern"], "left_semi"))
        like = found.where("like").select("kind", "surface").distinct()
        accepted = cut(score.where((F.col("score") >= ACCEPT) & ~F.col("seed")).select("kind", "surface").join(like, ["kind", "surface"], "left_semi"))
        # what was accepted induces patterns too
        more = found.join(accepted, ["kind", "surface"], "left_semi").select("kind", "surface", F.explode("patterns").alias("pattern"))
        fresh = cut(_useful(edges.unionByName(more)).join(known, ["kind", "pattern"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.union(fresh))
    confirmed = mentions.where(F.col("kind") == SECRET).withColumn("pattern", F.explode("patterns")).join(F.broadcast(known), ["kind", "pattern"], "left_semi")
    place = ("a", "b", "start", "kind", "end")
    return found.join(accepted, ["kind", "surface"], "left_semi").select(*place).union(confirmed.select(*place)).distinct()


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts of each kind, ``base_sha256``, ``spans`` (base and added ones) and their number.

    Offsets count code points, ends exclusive. Added spans are of the base kinds or ``secret``; one that overlaps an
    added span before it is left out, base spans stay as they are. Null texts count as empty. Repeated rows each give a
    row; in the graph equal strings of a kind are one instance. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = _seeds(docs)
    more = _added(docs, found.select("a", "b", F.explode("mentions").alias("m")).select("a", "b", "m.*"))
    point = lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))
    every = F.transform(F.filter("mentions", lambda m: m["kind"] < SECRET), point)
    out = found.withColumn("all", every)
    if more is not None:
        added = more.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "kind", "end"))).alias("added"))
        apart = F.filter("added", lambda m, i: (i == 0) | (m["start"] >= F.array_max(F.transform(F.slice("added", F.lit(1), F.greatest(i, F.lit(1))), lambda x: x["end"]))))
        out = out.join(added.withColumn("added", F.transform(apart, point)), ["a", "b"], "left")
        out = out.withColumn("all", F.array_sort(F.when(F.col("added").isNull(), F.col("all")).otherwise(F.concat("all", "added"))))
    names = F.array(*map(F.lit, NAMES))
    text = F.array_join(F.transform("all", lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), text.alias("spans"), F.size("all").cast("bigint").alias("n_spans"))
