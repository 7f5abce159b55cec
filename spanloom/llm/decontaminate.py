"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every benchmark item of n words is looked for in windows of n words; a document of fewer words is
one window, compared with every longer item. A window is fingerprinted by
the weighted SimHash of its five-word shingles; the index cuts the 64 bits into eight blocks of
eight, and two fingerprints within 23 bits agree in some block but for at most two bits, so
probing each block's value and all values one or two bits away finds every item within the
radius. Weighted Jaccard similarity of the shingles, 0.8 or more, then decides.

Windows that can't reach the similarity aren't fingerprinted: of an item and a window of weights a
and b, the common shingles must weigh 0.8 / 1.8 * (a + b) at least, and prefix sums over the places
where the item's shingles stand bound that from above for every window. No other window is left out.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut
from spanloom.llm.words import PLAIN, Grams, words_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: What sums of weights may be off by.
SLACK = 1e-6
#: Benchmark text that is sent to the tasks at once; a larger benchmark goes in slices.
SLICE_CHARS = 8_000_000

PROBES = np.array([sum(1 << b for b in c) for n in range(FLIPS + 1) for c in itertools.combinations(range(8), n)], np.uint8)


class Text:
    """Shingles of a lower-cased text: hash and weight (bytes of its words) at each word."""

    def __init__(self, text: str | None) -> None:
        words, starts, ends = words_of((text or "").lower(), PLAIN)
        self.n = len(words)
        self.grams = Grams(words)
        self.length = np.concatenate([[0], np.cumsum(ends - starts)])

    def shingles(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n words from start; fewer than five words are one shingle."""
        size = min(n, SHINGLE)
        at = np.arange(start, start + n - size + 1)
        return self.grams.at(at, size), (self.length[at + size] - self.length[at]).astype(np.float64)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.uint64:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * (weights @ bits) > weights.sum(), bitorder="little").view(np.uint64)[0]


class Item(NamedTuple):
    item_id: int
    n: int
    shingles: Counter
    weights: dict


class Index:
    """Items by fingerprint blocks, and the places of their shingles."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[Item] = []
        prints, places = [], []
        for item_id, text in items:
            t = Text(text)
            if t.n:
                h, w = t.shingles(0, t.n)
                places += [(int(x), len(self.items), o) for o, x in enumerate(h)]
                self.items.append(Item(item_id, t.n, Counter(h.tolist()), dict(zip(h.tolist(), w.tolist()))))
                prints.append(simhash(h, w))
        self.sizes = np.array([i.n for i in self.items], np.int64)
        self.weights = np.array([sum(c * i.weights[s] for s, c in i.shingles.items()) for i in self.items], np.float64)
        self.prints = np.array(prints, np.uint64)
        places.sort()
        self.keys = np.array([p[0] for p in places], np.uint64)
        self.owner = np.array([p[1] for p in places], np.int64)
        self.offset = np.array([p[2] for p in places], np.int64)
        values = self.prints.view(np.uint8).reshape(-1, BLOCKS) if len(prints) else np.zeros((0, BLOCKS), np.uint8)
        self.order = [np.argsort(values[:, b], kind="stable") for b in range(BLOCKS)]
        self.first = [np.searchsorted(values[self.order[b], b], np.arange(257)) for b in range(BLOCKS)]
        self.short = sorted({int(n) for n in self.sizes if n < SHINGLE})

    def search(self, fingerprint: np.uint64, n: int, whole: bool = False) -> np.ndarray:
        """Items of n words within the radius of a fingerprint; of n or more words for a whole text, which no item's window exceeds."""
        values = np.array([fingerprint]).view(np.uint8)
        found = [self.order[b][self.first[b][v]:self.first[b][v + 1]]
                 for b in range(BLOCKS) for v in (PROBES ^ values[b]).tolist()]
        found = np.unique(np.concatenate(found))
        found = found[self.sizes[found] >= n] if whole else found[self.sizes[found] == n]
        return found[np.bitwise_count(self.prints[found] ^ fingerprint) <= RADIUS]

    def windows(self, text: Text) -> set[tuple[int, int]]:
        """(start, words) of all windows whose shingles can reach the similarity with some item of that many words."""
        out: set[tuple[int, int]] = set()
        for size in [*self.short, SHINGLE]:
            hashes = text.grams.every(size) if text.n >= size else np.zeros(0, np.uint64)
            if not len(hashes):
                continue
            low = np.searchsorted(self.keys, hashes)
            hit = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == hashes)
            if not len(hit):
                continue
            high = np.searchsorted(self.keys, hashes[hit], side="right")
            many = high - low[hit]
            place = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            owner, at = np.unique(np.stack([self.owner[place], np.repeat(hit, many)]), axis=1)
            weight = (text.length[size:] - text.length[:-size]).astype(np.float64)
            found = np.bincount(owner, weights=weight[at], minlength=len(self.items))
            for item in np.flatnonzero(found >= SIMILARITY * self.weights - SLACK).tolist():
                n = min(int(self.sizes[item]), text.n)
                if min(n, SHINGLE) != size:
                    continue
                # windows start where they hold a place: sums of all weights, and of those of the item's shingles
                shared = np.zeros(len(weight))
                shared[at[owner == item]] = weight[at[owner == item]]
                span = n - size + 1
                total, common = (c[span:] - c[:-span] for c in (np.append(0.0, np.cumsum(v)) for v in (weight, shared)))
                least = SIMILARITY / (1 + SIMILARITY) * (total + self.weights[item])
                out.update((s, n) for s in np.flatnonzero(common >= least - SLACK).tolist())
        return out

    def matches(self, text: str | None) -> list[dict]:
        """Best window of each item found in a text, by item: the most similar, then the first."""
        if not self.items:
            return []
        t = Text(text)
        best: dict[int, tuple[float, int, int]] = {}
        for start, n in sorted(self.windows(t)):
            h, w = t.shingles(start, n)
            bag = Counter(h.tolist())
            weight = dict(zip(h.tolist(), w.tolist()))
            for i in self.search(simhash(h, w), n, n == t.n).tolist():
                s = similarity(bag, weight, self.items[i])
                if s >= SIMILARITY and s > best.get(i, (0.0,))[0]:
                    best[i] = s, start, n
        return [{"item_id": self.items[i].item_id, "start_word": s, "n_words": n, "similarity": round(x, 6)}
                for i, (x, s, n) in sorted(best.items())]


def similarity(bag: Counter, weight: dict, item: Item) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(c, bag[s]) * item.weights[s] for s, c in item.shingles.items() if s in bag)
    total = sum(c * weight[s] for s, c in bag.items()) + sum(c * item.weights[s] for s, c in item.shingles.items())
    return both / (total - both) if total > both else 1.0


def slices(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of bounded size, dealt by hash: one if it is within `SLICE_CHARS`."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // SLICE_CHARS))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def matcher(items: DataFrame):
    """A function that finds the items of one slice, of which the driver holds that slice only."""
    index = Index(sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))

    @F.pandas_udf("array<struct<item_id:long,start_word:int,n_words:int,similarity:double>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([index.matches(t) for t in texts], dtype=object)

    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for every document and item found in it.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns aren't read. Words are
    runs of letters, digits and non-ASCII characters in lower case. An item of fewer than five
    words is one shingle and found only whole. Of several windows the most similar counts, then the
    first. Null and wordless texts and items match nothing;
    repeated items and rows give repeated results; empty tables give none. A very long text is one
    row of its task, walked by prefix sums. The corpus is scanned
    once per benchmark slice, with no shuffle; several slices are found one after the other, each written before the next is read.
    """
    parts = slices(benchmark)
    found = lambda items: docs.select("doc_id", F.explode(matcher(items)("text")).alias("m")).select("doc_id", "m.*")
    if len(parts) == 1:
        return found(parts[0])
    return functools.reduce(DataFrame.union, [cut(found(p)) for p in parts])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found; the columns stay as they are."""
    parts = slices(benchmark)
    for i, items in enumerate(parts):
        docs = docs.where(F.size(matcher(items)("text")) == 0)
        docs = cut(docs) if i < len(parts) - 1 else docs
    return docs
