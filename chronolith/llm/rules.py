"""Quality rules: divergence of a text's histograms from references of languages.

Every text has two histograms: its code points by class, and its common words (the function words
of four languages, and one bin for all other words). A language's reference is the mean histogram of the
documents marked with it, so one long text counts as much as a short one: first of all that pass the base
rules, then of those of them that are near enough to the first references, so that junk has no part in the last ones. The
verdict compares a text with every reference by Jensen-Shannon distance (base 2, the square root of
the divergence) and takes the nearest, so a wrong language mark does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import lean, pieces, ship, utf8, written
from chronolith.llm.textstats import CLASSES, base

#: Function words of the known languages (fixed values).
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or which an they you were",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
_place = {w.encode(): i for i, w in enumerate(WORDS)}
#: Greatest distance from the nearest reference, and the fewest words for a verdict by classes.
FAR_CLASSES, FAR_WORDS, LEAST_CLASSES = 0.28, 0.266, 50
#: Texts of fewer words lie farther from their reference by chance: their square distance may be greater by WIDER * (1 / words - 1 / LEAST_WORDS).
LEAST_WORDS, WIDER = 200, 3.1
#: A language has a reference from so many documents on; of more languages than that, those with most documents have one.
LEAST_DOCS, LANGUAGES = 10, 256
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scan(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = OUT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got, classes, common = [], [], []
            for text in utf8(b.column(1)):
                words = (text or b"").split()
                found, hist, often = base(text or b"", words)
                row = np.zeros(len(WORDS), np.int32)
                for w, k in often.items():
                    if len(w) < 8 and (i := _place.get(w.strip(b".,").lower())) is not None:
                        row[i] += k
                got.append(found)
                classes.append(hist.tolist())
                common.append(row.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array([g[c] for g in got], pa.int64()) for c in counts), pa.array(classes, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int32()))],
                names=["doc_id", "lang", *counts, "classes", "common"],
            )

    return rows.mapInArrow(lean(scan), f"doc_id {kind}, lang string, {', '.join(f'{c} bigint' for c in counts)}, classes array<bigint>, common array<int>")


def _shares(classes: np.ndarray, common: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = np.maximum(words - common.sum(1), 0)
    full = np.c_[common, rest].astype(float)
    return classes / np.maximum(classes.sum(1, keepdims=True), 1), full / np.maximum(full.sum(1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from each row of q, both summing to 1."""

    def part(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    a, b = p[:, None, :], q[None, :, :]
    mid = (a + b) / 2
    return np.sqrt(np.maximum(part(a, mid) + part(b, mid), 0) / 2)


@dataclass
class References:
    """Mean histograms of languages; ``names`` in the order of the rows."""

    names: list[str]
    classes: np.ndarray
    words: np.ndarray

    def distances(self, classes: np.ndarray, common: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance from the nearest reference by classes and by common words; 0 without any."""
        p, q = _shares(classes, common, n_words)
        return tuple(js_distance(x, r).min(1) if len(r) else np.zeros(len(x)) for x, r in ((p, self.classes), (q, self.words)))


def far_words(words: np.ndarray) -> np.ndarray:
    """The greatest distance by common words of texts of so many words."""
    return np.sqrt(FAR_WORDS**2 + WIDER * np.maximum(1 / np.maximum(words, 1) - 1 / LEAST_WORDS, 0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(counted: DataFrame) -> References:
    """Mean histograms of each language over its documents in ``counted``, all of which have words.

    The aggregate keeps ``LANGUAGES`` rows at most.
    """
    points, words = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x), F.col("n_words").cast("double")
    sums = counted.where("lang is not null").groupBy("lang").agg(
        F.count("*").alias("n"),
        *(F.sum(F.col("classes")[i] / points).alias(f"c{i}") for i in range(len(CLASSES))),
        *(F.sum(F.col("common")[i] / words).alias(f"w{i}") for i in range(len(WORDS))),
    )
    rows = sums.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    classes = np.array([[r[f"c{i}"] / r["n"] for i in range(len(CLASSES))] for r in rows]).reshape(-1, len(CLASSES))
    common = np.array([[r[f"w{i}"] / r["n"] for i in range(len(WORDS))] for r in rows]).reshape(-1, len(WORDS))
    return References([r["lang"] for r in rows], classes, np.c_[common, np.maximum(1 - common.sum(1), 0)])


def _judged(counted: DataFrame, of: References) -> DataFrame:
    """counted with ``class_distance``, ``word_distance`` and ``far``."""
    kinds = {f.name: f.dataType.simpleString() for f in counted.schema}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            if not b.num_rows:
                continue
            words = b.column("n_words").to_numpy()
            hists = (b.column(c).flatten().to_numpy().reshape(-1, n) for c, n in (("classes", len(CLASSES)), ("common", len(WORDS))))
            near = of.distances(*hists, words)
            far = (near[0] > FAR_CLASSES) & (words >= LEAST_CLASSES) | (near[1] > far_words(words))
            # a language of its own script is not held against others
            if of.names:
                known = b.column("lang").is_null().to_numpy(zero_copy_only=False) | np.isin(b.column("lang").fill_null("").to_numpy(zero_copy_only=False).astype(str), of.names)
                far &= known
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near[0]), pa.array(near[1]), pa.array(far)], names=[*b.schema.names, "class_distance", "word_distance", "far"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return counted.mapInArrow(lean(judge), f"{schema}, class_distance double, word_distance double, far boolean")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict of every whole text.

    ``base_failed``: under 50 words, or over half the words in repeated three-word windows.
    ``kept``: false if base_failed; else false only if the text is far from every reference, by
    classes (from ``LEAST_CLASSES`` words) or by common words (:func:`far_words`, wider for short texts).
    Every language with ``LEAST_DOCS`` documents or more has a reference; texts marked with another are judged by the base
    rules alone, those without a mark like the rest. Null and empty texts have no words and fail. Without any
    reference (as in an empty table) no text is far. Repeated rows each give a row; a null id stays null. Other columns are not read.
    """
    ship(docs.sparkSession)
    counted = written(_scan(docs), "rules")
    sound = counted.where(~base_failed())
    first = references(sound)
    last = references(_judged(sound, first).where("not far")) if first.names else first
    return _judged(counted, last).select(
        "doc_id", *OUT, base_failed().alias("base_failed"), (~base_failed() & ~F.col("far")).alias("kept"), "class_distance", "word_distance"
    )
