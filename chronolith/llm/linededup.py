"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Every line has a hash; the rolling hash of two lines on end chooses where a chunk ends, so an inserted
line moves no boundary but those beside it. A line of ``PASSAGE`` words or more is a chunk by itself. Chunks
of several lines and ``LEAST`` words or more, and those long lines, are compared over all
documents byte by byte; of equal ones the first stays, by id and place, and the others go.

``line_dedup`` is that rule alone, as its SQL has it. ``passage_dedup`` also takes out every repeated run of
lines of ``PASSAGE`` words or more as a whole, wherever the chunks around it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import cut, free_name

#: One in so many lines ends a chunk; words of a long line; words of a chunk that may go.
EVERY, PASSAGE, LEAST = 2, 50, 20
BASE, PRIME = 31, 4294967291


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Compute columns once: a generator keeps later lambdas from computing them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _words(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def chunked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``__chunks``: an array of (text, may go, its first line, its last line)."""
    df = _held(df, __lines=F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = _held(
        df,
        __hash=F.transform("__lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint")),
        __long=F.transform("__lines", lambda x: _words(x) >= PASSAGE),
        __n=F.size("__lines"),
    )

    def ends(i: Column) -> Column:
        before = F.when(i > 0, F.get("__hash", i - 1)).otherwise(F.lit(0))
        rolled = F.pmod(F.pmod(before * BASE + F.get("__hash", i), F.lit(PRIME)), F.lit(EVERY)) == 0
        return (i == F.col("__n") - 1) | F.get("__long", i) | F.get("__long", i + 1) | rolled

    df = _held(df, __ends=F.filter(F.sequence(F.lit(0), F.col("__n") - 1), ends))

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("__ends", k - 1) + 1).otherwise(F.lit(0))
        joined = F.array_join(F.slice("__lines", start + 1, end - start + 1), "\n")
        spaces = F.length(joined) - F.length(F.translate(joined, " \n", "")) + 1
        may = F.get("__long", end) | ((end > start) & (spaces >= LEAST))
        return F.struct(joined.alias("text"), may.alias("may"), start.alias("a"), end.alias("b"))

    df = _held(df, __chunks=F.transform("__ends", chunk))
    return df.drop("__lines", "__hash", "__long", "__n", "__ends")


def _core(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one, ``__row``, so that no name of theirs meets one in use here."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("__row"))


def _unfolded(df: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """df, which has ``doc_id, text, __row``, with the columns of docs; ``n_chars`` follows the text."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": size}
    return df.select(*(own[c].alias(c) if c in own else F.col(f"__row.`{c}`").alias(c) for c in docs.columns), *more)


def _place(at: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__a", "__b", at.alias("at")).alias("place")


def _key(docs: DataFrame) -> list[Column]:
    """Two hashes that name a row by its id and text."""
    return [F.xxhash64("doc_id", "text").alias("__a"), F.hash(F.col("text"), F.col("doc_id")).alias("__b")]


def _copies(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with ``__a``, ``__b`` and ``__copy``: whether a row is like another in id and text and not the first of these; and whether any is.

    Most tables have no such rows, and then nothing more is done. Else the rows in question, and only they, are
    counted by all their columns: the first has the smallest hash, and of rows alike in everything one.
    """
    keyed, names = docs.select("*", *_key(docs)), ["__a", "__b"]
    alike = cut(keyed.groupBy(*names).count().where("count > 1").select(*names))
    one = keyed.withColumn("__copy", F.lit(False))
    if alike.isEmpty():
        return one, False
    many = keyed.join(alike, names, "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("__n")).withColumn("__hash", F.xxhash64(*docs.columns))
    many = many.join(many.groupBy(*names).agg(F.min("__hash").alias("__least")), names)
    many = many.withColumn("__copy", F.explode(F.transform(F.sequence(F.lit(1), F.col("__n")), lambda i: (i > 1) | (F.col("__hash") != F.col("__least")))))
    return one.join(alike, names, "left_anti").unionByName(many.select(*one.columns)), True


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with repeated chunks taken out, and ``n_chunks`` and ``n_removed``.

    Of equal chunks the one with the smallest (doc_id, row, place) stays, a null id last. Of rows alike in id and
    text one counts as the first. A null text stays null; texts without a repeated chunk stay as they are, to the
    byte. ``n_chars``, where there is one, follows the text. No row goes; an empty table gives none. Where docs has a column named
    ``n_chunks`` or ``n_removed`` it stays, and the new one has an underscore behind its name.
    """
    added = [free_name(c, docs.columns) for c in ("n_chunks", "n_removed")]
    core = _core(docs)
    # texts are cut anew for each use: writing the chunks takes as much disk as the texts
    cuts = chunked(core.select("doc_id", "text", *_key(core)))
    chunk = cuts.select("doc_id", "__a", "__b", F.posexplode("__chunks").alias("at", "chunk")).where("chunk.may")
    chunk = chunk.select(_place(F.col("at")), F.col("chunk.text").alias("chunk"), F.xxhash64("chunk.text").alias("digest"))
    groups = chunk.groupBy("chunk", "digest").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # Bytes are compared by the grouping; an occurrence then finds its group by two independent digests.
    groups = cut(groups.where("n > 1").select("digest", F.sha1("chunk").alias("check"), "first"))
    met = chunk.select("place", "digest", F.sha1("chunk").alias("check"))
    met = met.join(groups, ["digest", "check"]).where("place <> first")
    gone = cut(met.groupBy("place.__a", "place.__b").agg(F.collect_set("place.at").alias("__gone")))
    count = F.size("__chunks")
    places = F.sequence(F.lit(0), count - 1)
    lost = F.when(F.col("__copy"), F.filter(places, lambda i: F.get("__chunks", i)["may"])).otherwise(F.col("__gone"))
    out = _held(chunked(_copies(core)[0].join(gone, ["__a", "__b"], "left")), __lost=F.coalesce(lost, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(places, F.col("__lost")), lambda i: F.get("__chunks", i)["text"])
    number = F.when(F.col("text").isNull(), 0).otherwise(count).cast("bigint")
    out = out.withColumn("__count", number).withColumn("text", F.when(F.size("__lost") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return _unfolded(out, docs, F.col("__count").alias(added[0]), F.size("__lost").cast("bigint").alias(added[1]))


def _passages(df: DataFrame) -> DataFrame:
    """df with ``__runs``: for each line with words the least run of ``PASSAGE`` words that starts with it, and the least that ends with it.

    A repeated run of so many words is covered by such runs, which are repeated too: it starts with the
    first kind and ends with the last kind. Runs are (text, first line, last line).
    """
    df = _held(df, __lines=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    bare = F.transform("__lines", lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    words = F.transform(bare, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"[ \t\r\f\x0B]+"))))
    # the line of each word, and the first word of each line that has any
    df = _held(df, __of=F.flatten(F.transform(words, lambda n, i: F.array_repeat(i, n))))
    places = F.filter(F.sequence(F.lit(0), F.size("__of") - 1), lambda p: (p == 0) | (F.get("__of", p) != F.get("__of", p - 1)))
    df = _held(df, __starts=F.when(F.size("__of") > 0, places).otherwise(F.array().cast("array<int>")))

    def both(p: Column, k: Column) -> Column:
        last = F.coalesce(F.get("__starts", k + 1), F.size("__of")) - 1
        # a negative place has no word
        return F.array(
            F.struct(F.get("__of", p).alias("a"), F.get("__of", p + PASSAGE - 1).alias("b")),
            F.struct(F.when(last >= PASSAGE - 1, F.get("__of", last - PASSAGE + 1)).alias("a"), F.get("__of", p).alias("b")),
        )

    ends = F.array_distinct(F.flatten(F.transform("__starts", both)))
    df = _held(df, __ends=F.filter(ends, lambda x: x["a"].isNotNull() & x["b"].isNotNull()))
    joined = F.transform("__ends", lambda x: F.struct(F.array_join(F.slice("__lines", x["a"] + 1, x["b"] - x["a"] + 1), "\n").alias("text"), x["a"].alias("a"), x["b"].alias("b")))
    return _held(df, __runs=joined).drop("__lines", "__of", "__starts", "__ends")


def _all_runs() -> Column:
    """All chunks that may go and all least runs of a row, as (text, first line, last line)."""
    chunks = F.transform(F.filter("__chunks", lambda c: c["may"]), lambda c: F.struct(c["text"].alias("text"), c["a"].alias("a"), c["b"].alias("b")))
    return F.array_union(chunks, F.col("__runs"))


def _runs(core: DataFrame) -> DataFrame:
    """``place, b, digest``: all chunks that may go and all least runs of ``PASSAGE`` words, with their last lines.

    They are found twice, to count them and to meet their groups: writing them would take as much disk as the texts.
    """
    keyed = _passages(chunked(core.select("doc_id", "text", *_key(core))))
    out = keyed.select("doc_id", "__a", "__b", F.explode(_all_runs()).alias("run"))
    return out.select(_place(F.col("run.a")), F.col("run.b").alias("b"), F.unhex(F.sha1("run.text")).alias("digest"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without the lines of repeated chunks and of repeated runs of ``PASSAGE`` words or more.

    A line goes if a run of lines that holds it, a chunk that may go or any run of so many words, is
    found before, by (doc_id, row, place), a null id last, or in the first of rows alike in id and text; runs are equal if their SHA-1 is. Blank lines at a
    run's ends, or beside a line of ``PASSAGE`` words, may stay. Nulls, other rows and ``n_chars`` are
    treated as by :func:`line_dedup`.
    """
    core = _core(docs)
    runs = _runs(core)
    groups = runs.groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    groups = cut(groups.where("n > 1").select("digest", "first"))
    met = runs.join(groups, "digest").where("place <> first")
    gone = cut(met.groupBy("place.__a", "place.__b").agg(F.collect_set(F.struct(F.col("place.at").alias("a"), "b")).alias("__gone")))
    marked, alike = _copies(core)
    keyed, own = marked.join(gone, ["__a", "__b"], "left"), F.col("__gone")
    if alike:
        # a copy loses all that its first row was found to have
        keyed = _passages(chunked(keyed))
        own = F.when(F.col("__copy"), F.transform(_all_runs(), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))).otherwise(own)
    keyed = _held(keyed, __spans=own)
    lost = F.flatten(F.transform("__spans", lambda x: F.sequence(x["a"], x["b"])))
    keyed = _held(keyed, __lines=F.when(F.size("__spans") > 0, F.split("text", "\n", -1)), __lost=F.array_distinct(lost))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return _unfolded(keyed.withColumn("text", text), docs)
