"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on the log loss, one feature after another in cycles, each on the bins of
its feature alone; what they add up to is a lookup table for each feature. Pairs of features that
explain most of what is left get tables of their own in the same way. A score is the logistic of a
sum of table entries. The model is fitted on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import free_name, lean, pieces, ship, utf8
from chronolith.llm.rules import _place
from chronolith.llm.textstats import base

#: Rows that the model is fitted on, at most: those whose hash of the id is smallest.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, CYCLES, PAIR_CYCLES, RATE, LEAST = 48, 8, 8, 60, 30, 0.2, 20
THRESHOLD = 0.3
FEATURES = (
    "words", "word_length", "upper", "digits", "stops", "marks", "symbols", "beyond", "repeated",
    "twice", "distinct", "lines_again", "line_length", "common", "blank", "bare",
)


def features(text: bytes | None) -> list[float]:
    """The features of a whole text; all zero for null and empty ones."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, classes, often = base(text, words)
    count, points = len(words), max(int(classes.sum()), 1)
    common = sum(k for w, k in often.items() if len(w) < 8 and w.strip(b".,").lower() in _place)
    bare = sum(k for w, k in often.items() if len(w) == 1)
    lower, upper, digit, blank, _, stop, mark, symbol, _, beyond = (classes / points).tolist()
    return [
        np.log1p(count), n["word_chars"] / count, upper / (upper + lower + 1e-9), digit, stop, mark, symbol, beyond,
        n["n_repeat_words"] / count, n["n_twice"] / count, n["n_distinct"] / count,
        n["n_dup_lines"] / max(n["n_lines"], 1), np.log1p(count / max(n["n_lines"], 1)),
        common / count, blank, bare / count,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            a, b = (np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (i, j))
            total += table[a, b]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of so many levels on one binned feature."""
    best, at = 0.0, 0
    if depth and len(g) > 1:
        left, hess, seen = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = _gain(left, hess) + _gain(g.sum() - left, h.sum() - hess) - _gain(g.sum(), h.sum())
        gain[(seen < LEAST) | (n.sum() - seen < LEAST)] = 0
        at = int(gain.argmax())
        best = gain[at]
    if best <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(x[0], x[1], x[2], depth - 1) for x in ((g[: at + 1], h[: at + 1], n[: at + 1]), (g[at + 1 :], h[at + 1 :], n[at + 1 :]))])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """One split of the first feature, then one of the second in each half; the gain of them."""
    whole, best = _gain(g.sum(), h.sum()), (np.full(g.shape, g.sum() / (h.sum() + 1.0)), 0.0)
    for cut in range(1, g.shape[0]):
        out, total = np.zeros(g.shape), -whole
        for rows in (slice(0, cut), slice(cut, None)):
            leaf = _tree(g[rows].sum(0), h[rows].sum(0), n[rows].sum(0), 1)
            out[rows] = leaf
            for v in np.unique(leaf):
                part = leaf == v
                total += _gain(g[rows][:, part].sum(), h[rows][:, part].sum())
        if total > best[1]:
            best = (out, total)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels y (0 or 1); with one class or no rows, the constant of its share."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    edges = [_cuts(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [_cuts(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(width)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    wide = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j in range(width):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), np.bincount(bins[j], minlength=size))
            model.tables[j] += step
            total += step[bins[j]]

    def grids(i: int, j: int) -> tuple[np.ndarray, ...]:
        g, h = slopes()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = wide[i] * shape[1] + wide[j]
        return tuple(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(g))))

    left = sorted(((_pair_tree(*grids(i, j))[1], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in left[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_CYCLES):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _pair_tree(*grids(i, j))[0]
            model.pair_tables[k] += step
            total += step[wide[i], wide[j]]
    return model


def _measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    rows = docs.select(*carried, "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            flat = np.array([features(t) for t in utf8(b.column("text"))], float).ravel()
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), x], names=[*carried, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lean(scan), f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5) -> Model:
    """Fit on labelled rows whose crc32(id) mod ``fold`` is not 0, at most SAMPLE of them.

    Rows of one id with several labels, a null id, or a label other than 0 and 1 are left out.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most"))
    marks = marks.where("y = most").where(F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "y")
    # of several texts of one id the one with the least features counts
    rows = _measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in rows.collect())
    x = np.array([r[2] for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but the text, and ``score`` and ``predicted`` of every whole text.

    Null and empty texts score as texts without words. Repeated rows each give a row; an empty table gives none. Where docs has a
    column of either name it stays, and the new one has an underscore behind its name.
    """
    carried = [c for c in docs.columns if c != "text"]
    return _scored(docs, model, threshold, carried, [free_name(c, docs.columns) for c in ("score", "predicted")])


def _scored(docs: DataFrame, model: Model, threshold: float, carried: list[str], added: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(*(f"`{c}`" for c in carried), *(["text"] if "text" not in carried else []))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([features(t) for t in utf8(b.column("text"))], float).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*carried, *added],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in carried)
    return rows.mapInArrow(lean(scan), f"{schema}`{added[0]}` double, `{added[1]}` int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject.

    Null, empty and repeated texts are judged by their score like any other; an empty table gives none. Without labels every row
    has the same score, 0.5, and stays.
    """
    added = [free_name(c, docs.columns) for c in ("score", "predicted")]
    kept = _scored(docs, train(docs, labels), THRESHOLD, docs.columns, added).where(F.col(added[1]) == 1)
    return kept.select(*(f"`{c}`" for c in docs.columns))
