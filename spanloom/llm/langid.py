"""Language ID: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest ridge regression.

Two texts compare by the n-grams (one to three characters) that both have:
k(x, y) = |x & y| / sqrt(|x| |y|), over n-grams hashed into `BUCKETS` presence bits. Landmarks
from the training sample span the Nyström feature space; a ridge regression per language scores
it. Whole batches are scored by two matrix products.

The training sample is bounded: at most `PER_LANGUAGE` rows of each language, and of all languages
`TRAIN_ROWS` (or one of each, if there are more languages), of at most
`TRAIN_CHARS` characters, picked by the least hash of the text in each of as many hash buckets. Landmarks are bounded in the same way.
Everything else covers all rows, and prediction reads whole texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = (1, 2, 3)
BUCKETS = 1 << 14
PER_LANGUAGE = 160
TRAIN_CHARS = 20_000
TRAIN_ROWS = 8000
LANDMARKS = 40          # of each language
ALL_LANDMARKS = 2000
RIDGE = 1e-2
ROWS = 256              # of one matrix product


def grams(text: str) -> np.ndarray:
    """Hash buckets of the n-grams of a text; what isn't a letter counts as one space between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = np.where((codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170)), np.uint32(32), codes)
    codes = np.concatenate([np.full(1, 32, np.uint32), codes, np.full(1, 32, np.uint32)])
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    out, state = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(SPANS) + 1):
        state = state[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
        if n in SPANS:
            mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out)


def presence(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(x, texts):
        row[grams(text)] = 1
    return x


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.sqrt(np.outer(x.sum(axis=1), y.sum(axis=1)))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray   # packed presence bits
    weights: np.ndarray     # landmark kernel values and a constant -> scores

    def scores(self, texts: list[str]) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        out = []
        for low in range(0, len(texts), ROWS):
            k = kernel(presence(texts[low:low + ROWS]), marks)
            out.append(np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights)
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred and score of each text; `und` and 0 for texts without a letter, or without a trained language."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if known and self.languages:
            s = self.scores([texts[i] for i in known])
            label[known] = np.array(self.languages, object)[s.argmax(axis=1)]
            score[known] = np.clip((s.max(axis=1) + 1) / 2, 0, 1).round(6)
        return pd.DataFrame({"lang_pred": label, "score": score})


def fit(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((1, 0)))
    labels = np.array(labels, object)
    x = presence(texts)
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    picked = np.concatenate([np.flatnonzero(labels == c)[:each] for c in languages])[:max(ALL_LANDMARKS, 1)]
    marks = x[picked]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])       # K_mm ** -1/2 on its range
    phi = np.hstack([kernel(x, marks) @ root, np.ones((len(x), 1))])
    y = np.where(labels[:, None] == np.array(languages, object), 1.0, -1.0)
    share = np.array([(labels == c).sum() for c in labels])[:, None]
    phi_w = phi / share                                   # every language weighs the same
    w = np.linalg.solve(phi_w.T @ phi + RIDGE / len(languages) * np.diag([*[1.0] * (phi.shape[1] - 1), 1e-3]), phi_w.T @ y)
    weights = np.vstack([root @ w[:-1], w[-1:]])
    return Model(languages, np.packbits(marks.astype(np.uint8), axis=1), weights.astype(np.float32))


def held_out() -> Column:
    """True for documents that are kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model of the labelled documents outside the held-out fold, of a sample as bounded above.

    Rows without id, text, letter or lang teach nothing. The sample doesn't depend on the order
    of the rows: ties of the hash are equal texts.
    """
    rows = docs.select("lang", "text", F.xxhash64("text").alias("h")).where(
        ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
        & F.char_length("text").between(1, TRAIN_CHARS))
    least = rows.groupBy("lang", F.pmod("h", F.lit(PER_LANGUAGE)).alias("bucket")).agg(F.min("h").alias("h"))
    chosen: dict[str, list[int]] = {}
    for r in least.collect():
        chosen.setdefault(r["lang"], []).append(r["h"])
    each = max(1, min(PER_LANGUAGE, TRAIN_ROWS // max(1, len(chosen))))
    wanted = docs.sparkSession.createDataFrame([(g, h) for g, hashes in chosen.items() for h in sorted(hashes)[:each]], "lang string, h long")
    sample = rows.join(F.broadcast(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()
    sample = sorted((r for r in sample if has_letter(r["text"])), key=lambda r: (r["lang"], r["h"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predictor(model: Model):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts.tolist())

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang).

    Null texts and texts without a letter are `und` with score 0; so is all if nothing is
    labelled. Equal texts get equal results, repeated rows repeated results. Columns besides these
    three aren't read, and lang only in training. A very long text is scored whole and never learned from; of equal
    scores the first language by name wins. An empty table gives no rows. Two scans pick the
    sample (bounded, collected), one scores; no text is shuffled but the sample's.
    """
    predict = predictor(train(docs))
    scored = docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that have a language; those that are `und` go."""
    predict = predictor(train(docs))
    return docs.where(predict("text")["lang_pred"] != "und")
