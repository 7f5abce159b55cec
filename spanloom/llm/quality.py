"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is binned, and shallow trees on one feature at a time, boosted in cycles over all
features, add up to a lookup table for each feature; then trees over two features, for the pairs whose
residuals gain most, add up to tables of pairs. A text's score is the logistic of the sum of its bins' entries.

The training sample is bounded: at most `TRAIN_ROWS` labelled rows of each label, those of the least
hash of the text. Features are computed where the texts lie, over whole texts; only the sample's features reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.langid import held_out
from spanloom.llm.words import SPACED, words_of

TRAIN_ROWS = 5000       # of each label
BINS = 32               # of a feature
PAIR_BINS = 8           # of a feature in a pair
PAIRS = 6
CYCLES = 150
PAIR_CYCLES = 60
RATE = 0.1
RIDGE = 1.0
LEAST = 3.0             # hessian of a leaf
THRESHOLD = 0.3

FEATURES = ("log_bytes", "letters", "capitals", "digits", "stops", "marks", "spaces", "word_mean", "word_spread", "distinct_words", "same_as_before",
            "distinct_pairs", "capital_starts", "mark_ends", "bare_marks", "commonest", "log_line", "stopped_lines", "distinct_lines")

_UPPER, _LOWER, _DIGIT, _STOP, _SPACE, _HIGH, _MARK = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[ord("A"):ord("Z") + 1] = _UPPER
_KIND[ord("a"):ord("z") + 1] = _LOWER
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[list(b".,;:'\"?-()")] = _STOP
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[128:] = _HIGH


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of `FEATURES`; shares of nothing are 0."""
    words, starts, ends = words_of(text, SPACED)
    data = np.frombuffer((text or "").encode(), np.uint8)
    kinds = _KIND[data]
    upper, lower, digit, stop, space, high, mark = np.bincount(kinds, minlength=7)[:7].tolist()
    n, ink = max(1, len(data)), max(1, len(data) - space)
    w = max(1, len(words))
    sizes = ends - starts
    ordered = np.sort(words)
    change = np.flatnonzero(np.diff(ordered)) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], change + 1, [len(words)]])) if len(words) else np.zeros(1, np.int64)
    pairs = words[:-1] * np.uint64(31) + words[1:]
    first, last = kinds[starts], kinds[ends - 1]
    lines = (text or "").split("\n")
    filled = [x for x in lines if x.strip()]
    return [
        float(np.log1p(len(data))), (upper + lower + high) / ink, upper / max(1, upper + lower), digit / ink, stop / ink, mark / ink, space / n,
        float(sizes.mean()) if len(sizes) else 0.0, float(sizes.std()) if len(sizes) else 0.0, len(counts) / w if len(words) else 0.0,
        float((words[1:] == words[:-1]).sum()) / w, len(np.unique(pairs)) / w,
        float((first == _UPPER).sum()) / w, float((last == _MARK).sum()) / w, float(((sizes == 1) & (first == _MARK)).sum()) / w,
        float(counts.max()) / w, float(np.log1p(len(data) / max(1, len(filled)))),
        sum(x.rstrip().endswith((".", "?", ":")) for x in filled) / max(1, len(filled)), len(set(filled)) / max(1, len(filled)),
    ]


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]                                 # inner bounds of each feature's bins
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features, in whole columns."""
        total = np.full(len(x), self.intercept)
        for column, edges, table in zip(x.T, self.edges, self.tables):
            total += table[np.searchsorted(edges, column, side="right")]
        if self.pairs:
            coarse = [np.searchsorted(edges, column, side="right") for column, edges in zip(x.T, self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def bounds(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner bounds of at most `bins` bins of about equal numbers, each a value that a row has."""
    cuts = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))
    return cuts[cuts > column.min()]


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right leaf) of the best cut of a row of bins; no gain if none leaves both sides enough."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gains = np.where((left_h >= LEAST) & (right_h >= LEAST), gain(left_g, left_h) + gain(right_g, right_h) - gain(g.sum(), h.sum()), 0.0)
    if not len(gains):
        return 0.0, 0
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + RIDGE)


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps for each bin, of a tree with up to three leaves."""
    spans = [(0, len(g))]
    for _ in range(2):
        found = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in spans]
        best, at, a, b = max(found, key=lambda c: c[0])
        if best <= 0:
            break
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = leaf(g[a:b], h[a:b])
    return out


def square_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps for each cell) of the best tree that cuts one feature and then, in both halves, the other."""
    best, steps = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out, total = np.zeros_like(a), -gain(a.sum(), b.sum())
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(axis=0), b[part].sum(axis=0)
                more, at = best_cut(pg, ph)
                total += more + gain(pg.sum(), ph.sum())
                for side in ((slice(0, at), slice(at, None)) if more > 0 else (slice(None),)):
                    out[part, side] = leaf(pg[side], ph[side])
            if total > best:
                best, steps = float(total), out.T if turned else out
    return best, steps


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows of features and labels 0 and 1; without both labels, the labels' mean (a half without rows)."""
    width = x.shape[1]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    intercept = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Model(intercept, [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    edges = [bounds(c, BINS) for c in x.T]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, (bins, table) in enumerate(zip(binned, tables)):
            if len(table) > 1:
                g, h = slopes()
                step = line_tree(np.bincount(bins, g, len(table)), np.bincount(bins, h, len(table)))
                table += step
                total += step[bins]
    pair_edges = [bounds(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(pair_edges, x.T)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        at = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-square_tree(*cells(i, j))[0], i, j) for i in range(width) for j in range(i + 1, width)))
    pairs = [(i, j) for worth, i, j in ranked[:PAIRS] if worth < 0]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_CYCLES):
        for (i, j), table in zip(pairs, pair_tables):
            _, step = square_tree(*cells(i, j))
            table += step
            total += step[coarse[i], coarse[j]]
    for bins, table in zip(binned, tables):     # every table has mean 0 over the sample; the intercept takes the rest
        shift = table[bins].mean()
        table -= shift
        intercept += shift
    return Model(float(intercept), edges, tables, pair_edges, pairs, pair_tables)


def with_features(rows: DataFrame, schema: str) -> DataFrame:
    """`rows`, of which a column is text, as the columns of `schema` and an array of features in place of the text."""
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(x=[features(t) for t in batch["text"]])

    return rows.mapInPandas(put, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows outside the held-out fold, a sample as bounded above.

    A text of `docs` (doc_id, text) counts once for each quality, 0 or 1, that `labels` (doc_id, quality) give its rows;
    ids or qualities that are null teach nothing. The sample doesn't depend on the order of rows.
    """
    known = docs.where(~held_out()).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    wanted = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    hashed = known.select("doc_id", "h").join(wanted, "doc_id")
    least = [hashed.where(F.col("y") == y).orderBy("h", "doc_id").limit(TRAIN_ROWS) for y in (0, 1)]
    sample = F.broadcast(least[0].union(least[1]).groupBy("doc_id", "h", "y").agg(F.count("*").alias("copies")))
    chosen = known.join(sample, ["doc_id", "h"]).select("text", "h", "y").dropDuplicates(["h", "y"])
    rows = with_features(chosen, "h long, y int").toPandas().sort_values(["h", "y"])
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text); labels (doc_id, quality) are only learned from.

    Null texts count as empty; empty texts have features of zeros and are scored like others. Equal texts
    get equal scores, repeated rows repeated results; texts that repeat in the sample teach once for each label they have.
    Without labelled rows all scores are 0.5. Very long texts are read whole, one row of their task. Other columns aren't read;
    an empty table gives no rows. Two scans pick the sample (bounded, broadcast), one scores; no text but the sample's is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))).round(9))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that `scored` predicts to be of quality 1; null and empty texts are scored like others."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))) >= THRESHOLD)

    return docs.where(good("text"))
