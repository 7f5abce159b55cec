"""Suffix-array dedup: passages of fifty words or more that stand in several documents.

Sparse suffix array: of every run of `MIN_WORDS` words, the suffix at the least-hashed `GRAM`-word
gram is retained, so a repeated passage retains the same suffixes wherever it stands. A retained
suffix carries the runs that chose it, one digest each: they reach from the gram to the left and
to the right. Suffixes are sorted by gram; neighbours with an equal gram are compared run by run, and
a match is extended to the left and to the right over all runs that follow one another.

Every run of a text is carried by one suffix, the same in every document, so equal runs always
meet. A digest has 32 bits beside the 64 of the gram: of two runs that share a gram and differ, one
pair in four thousand million is taken for equal.

Scale: one Python pass over the texts and one shuffle of the suffixes by gram. Grams that a bounded
sample of documents shows to be frequent are spread over `PIECES` tasks by document; these, and any
group over `GROUP` rows, are settled piece by piece, and a shuffle of the runs of one document of
each piece compares the pieces. The sample only balances the tasks: whatever it holds, no pair of documents is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut
from spanloom.llm.words import SPACED, Grams, mix, words_of

MIN_WORDS = 50
GRAM = 16
GROUP = 20_000
#: Documents looked at for frequent grams, the share of them that makes a gram frequent, and the tasks such a gram is spread over.
SAMPLE = 4000
FREQUENT = 0.004
PIECES = 64

SUFFIX = "key long, doc_id long, first int, runs binary"
FOUND = "doc_id long, first int, last int, other long, run long"
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def suffixes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, count, digests): gram hash of each retained suffix, first run that chose it, how many did, and the digests of all runs."""
    words, _, _ = words_of(text, SPACED)
    if len(words) < MIN_WORDS:
        return words[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    grams = Grams(words)
    hashes = grams.every(GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, MIN_WORDS - GRAM + 1)
    # positions of the least grams never fall, so the runs that choose one suffix are neighbours
    at, first, count = np.unique(windows.argmin(axis=1) + np.arange(len(windows)), return_index=True, return_counts=True)
    return hashes[at], first, count, (grams.every(MIN_WORDS) >> np.uint64(32)).astype(np.uint32)


def retained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), 500):
            keys, docs, firsts, runs = [], [], [], []
            for doc_id, text in zip(batch["doc_id"][low:low + 500], batch["text"][low:low + 500]):
                key, first, count, digests = suffixes(text)
                keys.append(key)
                docs.append(np.full(len(key), doc_id, np.int64))
                firsts.append(first)
                data = digests.tobytes()
                runs += [data[4 * a:4 * b] for a, b in zip(first.tolist(), (first + count).tolist())]
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(docs),
                                "first": np.concatenate(firsts).astype(np.int32), "runs": runs})


def spread(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, doc_id, start) of every run of some suffixes, sorted by run, so equal runs are neighbours."""
    key, doc, first, runs = rows
    count = np.array([len(r) // 4 for r in runs], np.int64)
    digest = np.frombuffer(b"".join(runs), np.uint32).astype(np.uint64)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    run = mix(np.repeat(key.view(np.uint64), count) + digest * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(run, kind="stable")
    return run[order], np.repeat(doc, count)[order], (np.repeat(first, count) + step)[order]


def extremes(run: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted runs the least and the greatest document that has it."""
    at = np.flatnonzero(np.append(True, run[1:] != run[:-1])[:len(run)])
    sizes = np.diff(np.append(at, len(run)))
    return tuple(np.repeat(f.reduceat(doc, at), sizes) if len(at) else doc for f in (np.minimum, np.maximum))


def settled(rows: Rows) -> pd.DataFrame:
    """Passages among suffixes of whole groups, sorted by key."""
    key, doc = rows[:2]
    new = np.append(True, key[1:] != key[:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))[group]
    run, doc, start = spread(tuple(v[several] for v in rows))
    low, high = extremes(run, doc)
    hit = low != high
    return extended(doc[hit], start[hit], np.where(doc == low, high, low)[hit])


def extended(doc: np.ndarray, start: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """Runs that follow one another in a document with the same partner, as one passage."""
    order = np.lexsort((start, other, doc))
    doc, start, other = doc[order], start[order], other[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (start[1:] > start[:-1] + 1))[:len(doc)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1 if len(heads) else heads
    return pd.DataFrame({"doc_id": doc[heads], "first": start[heads].astype(np.int32),
                         "last": (start[tails] + MIN_WORDS).astype(np.int32), "other": other[heads],
                         "run": pd.array([None] * len(heads), dtype="Int64")})


def unsettled(rows: Rows) -> Iterator[pd.DataFrame]:
    """Passages of suffixes whose group may go on elsewhere, and the runs that are still to be compared there.

    A run of several documents here is settled for all but the document of the smallest id, which
    stands for them: only its runs are listed, each with its hash and a second document that has it.
    """
    run, doc, start = spread(rows)
    if not len(run):
        return
    low, high = extremes(run, doc)
    done = doc != low
    yield extended(doc[done], start[done], low[done])
    # equal runs of that document whose words touch are one row, however often a text repeats itself
    left = np.flatnonzero(~done)
    left = left[np.lexsort((start[left], run[left]))]
    run, doc, start, high = run[left], doc[left], start[left], high[left]
    heads = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (start[1:] > start[:-1] + MIN_WORDS)))
    tails = np.append(heads[1:], len(run)) - 1
    yield pd.DataFrame({"doc_id": doc[heads], "first": start[heads].astype(np.int32), "last": (start[tails] + MIN_WORDS).astype(np.int32),
                        "other": high[heads], "run": pd.array(run[heads].view(np.int64), dtype="Int64")})


def neighbours(frequent: np.ndarray):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk one sorted partition: settle whole groups, list the runs of the frequent and the large ones."""
        rest: Rows | None = None
        large: int | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = tuple(batch[c].to_numpy() for c in ("key", "doc_id", "first", "runs"))
            if rest is not None:
                rows = tuple(np.concatenate(v) for v in zip(rest, rows))
            key = rows[0]
            last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            was = large
            if len(key) - last > GROUP:
                large, last = int(key[-1]), len(key)
            yield from split(tuple(v[:last] for v in rows), was, large)
            rest = tuple(v[last:] for v in rows)
        if rest is not None:
            yield from split(rest, large, large)

    def split(rows: Rows, was: int | None, large: int | None) -> Iterator[pd.DataFrame]:
        if not len(rows[0]):
            return
        open_ = np.isin(rows[0], frequent) | (rows[0] == was) | (rows[0] == large)
        if open_.any():
            yield from unsettled(tuple(v[open_] for v in rows))
        if not open_.all():
            yield settled(tuple(v[~open_] for v in rows))

    return compare


def frequent_keys(texts: DataFrame) -> np.ndarray:
    """Keys that `FREQUENT` of a sample of at most about `SAMPLE` documents share; a document has few keys, so they are few."""
    n = texts.count()
    some = texts.sample(min(1.0, SAMPLE / n), seed=1) if n else texts
    counts = some.mapInPandas(retained, SUFFIX).groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= max(4, FREQUENT * min(n, SAMPLE))).select("key").collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, other): words [first, last) of a document, each run of which also stands in document `other`.

    `other` is less than doc_id where any smaller id has these runs.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    frequent = frequent_keys(texts)
    rows = texts.mapInPandas(retained, SUFFIX)
    hot = F.col("key").isin(frequent.tolist()) if len(frequent) else F.lit(False)
    salt = F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(PIECES))).otherwise(F.lit(0))
    array = rows.repartition("key", salt).sortWithinPartitions("key", "doc_id", "first")
    found = cut(array.mapInPandas(neighbours(frequent), FOUND))
    loose = found.where("run is not null")
    shared = loose.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("other").alias("high")).where("low <> high")
    loose = loose.drop("other")
    joined = loose.join(shared, "run").select(
        "doc_id", "first", "last", F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    return found.where("run is null").select("doc_id", "first", "last", "other").union(joined)


def passages(spans: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, other_doc_id): overlapping and touching spans of a document as one."""
    by_doc = Window.partitionBy("doc_id").orderBy("first", "last")
    spans = spans.groupBy("doc_id", "first", "last").agg(F.min("other").alias("other"))
    spans = spans.withColumn("reached", F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("passage", F.sum(F.when(F.col("first") <= F.col("reached"), 0).otherwise(1)).over(by_doc))
    return spans.groupBy("doc_id", "passage").agg(
        F.min("first").alias("first_word"), F.max("last").alias("end_word"), F.min("other").alias("other_doc_id")).drop("passage")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, other_doc_id): the passages of every document that repeat elsewhere.

    A passage is a longest stretch of words, each of which lies in a run of `MIN_WORDS` or more
    equal words of another document; other_doc_id is one of those, of a smaller id than the
    document's own wherever such a one has some of its runs. Words are
    what ASCII white space separates, compared exactly. Null and shorter texts, and rows without
    doc_id, have none; repeats inside one document, or between rows of one doc_id, don't count.
    A very long text is one row of its task and gives one suffix for some eighteen words.
    Other columns aren't read; an empty table gives no rows.
    """
    found = passages(matches(docs))
    return found.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "other_doc_id")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without the runs that also stand in a document of a smaller id; other text stays byte by byte.

    Whether a run goes is decided for each run by itself, so what is removed still stands in the
    smallest document that has it.
    """
    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans):
            if text is not None and gone is not None:
                data = text.encode()
                _, starts, ends = words_of(text, SPACED)
                pieces, at = [], 0
                for s in sorted(gone, key=lambda s: s["first_word"]):
                    pieces.append(data[at:starts[s["first_word"]]])
                    at = ends[s["end_word"] - 1]
                text = b"".join([*pieces, data[at:]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    gone = passages(matches(docs).where("other < doc_id")).groupBy(F.col("doc_id").alias("__gone_id")).agg(
        F.collect_list(F.struct("first_word", "end_word")).alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left")
    return joined.withColumn("text", cut_out("text", "__gone")).select(*docs.columns)
