"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced block comparison.

Candidates come from five blocks of the 64 bits: two fingerprints that differ in at most three
bits agree in at least two whole blocks, so each of the ten pairs of blocks is a bucket key. The
fingerprints of a bucket are stored as vertical bit planes and compared 64 at a time.

Scale: texts are read once and never shuffled; equal fingerprints are one node, so exact copies
cost nothing further; a bucket over `BUCKET` fingerprints is cut into chunks and compared chunk
pair by chunk pair in separate tasks, with no pair left out; each task returns a spanning forest
of its links, not the links. Components are found by distributed star contraction.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import bitslice, buckets
from spanloom.llm.common import connected_components, cut, stored
from spanloom.llm.words import mix

RADIUS = 3
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
BUCKET = 1024


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Big-endian XXH64 digests (seed 42) of the word shingles of a text, one row of 8 bytes each.

    Words are runs without ASCII white space after lower-casing A-Z. A text of fewer words than
    `size` has one shingle, its whole word sequence; a text without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, 42), np.uint8).reshape(1, 8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    return np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1:].tolist())]),
                         np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash as a signed 64-bit integer: a bit is 1 if it is set in over half the hashes."""
    hashes = shingle_hashes(text, size)
    totals = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 4096):
        totals += np.unpackbits(hashes[low:low + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def block_masks() -> list[int]:
    """For each pair of blocks the bits they hold, as signed 64-bit integers."""
    ends = list(itertools.accumulate(BLOCKS))
    blocks = [((1 << n) - 1) << (end - n) for n, end in zip(BLOCKS, ends)]
    return [(m ^ (1 << 63)) - (1 << 63) for m in (a | b for a, b in itertools.combinations(blocks, 2))]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        groups = [np.asarray(g, np.int64) for g in batch["members"]]
        if not groups:
            continue
        sizes = np.array([len(g) for g in groups])
        flat = np.concatenate(groups).view(np.uint64)
        a, b = bitslice.linked(flat, np.cumsum(sizes) - sizes, RADIUS)
        yield pd.DataFrame({"a": flat[a].view(np.int64), "b": flat[b].view(np.int64)}).drop_duplicates()


def fingerprint_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all fingerprints of `nodes` (distinct, column fp) within the radius."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                     for i, m in enumerate(block_masks())])
    keyed = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.band", "key.bits")
    shared = keyed.groupBy("band", "bits").agg(F.count("*").alias("n")).where("n > 1")
    chunked = keyed.join(shared, ["band", "bits"]).withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    chunked = chunked.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # chunk i meets every chunk j: the pair (min, max) is one group, (i, i) stands for itself only
    meets = chunked.select("band", "bits", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    groups = meets.groupBy("band", "bits", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(
        F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return groups.select("members").mapInPandas(_forests, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    Rows are linked if their fingerprints differ in at most three bits; component_id is the
    smallest doc_id reachable. Null and wordless texts have fingerprint 0 and are linked like any
    other. Rows that share a doc_id stay separate rows of one component if their texts agree. A
    row without doc_id keeps a null id; its component is the smallest known id reachable, or null.
    A bit that is set in just half the hashes is 0. A very long text is one row of its task, its bits summed by blocks. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    marked = cut(docs.select("doc_id", fingerprint_udf(F.col("text")).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    classes = connected_components(fingerprint_links(nodes))
    joined = nodes.join(classes, nodes["fp"] == classes["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = joined.join(least, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


# Stages on texts: five-word shingles, and an exact check of their similarity.
STAGE_SHINGLE = 5
SIMILARITY = 80     # per cent
#: Bits that fingerprints of similar texts may differ in: at similarity 0.8 they differ in 9.7 of 64 on average, with a deviation of 2.9.
STAGE_RADIUS = 20
#: Blocks that texts are compared in: bands of so many least shingle hashes; texts of similarity 0.8 share one with chance 0.991.
STAGE_BLOCKS = 9
STAGE_ROWS = 4
STAGE_KEYS = [f"k{b}" for b in range(STAGE_BLOCKS)]
SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("size", "bits", *STAGE_KEYS)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_id(text: Column) -> Column:
    """Hash of the words of a text, the same for texts of equal words."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x09-\\x0D\\x20]+", " ")
    return F.xxhash64(F.trim(plain))


def stage_shingles(text: str | None) -> np.ndarray:
    """The different hashes of the five-word shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, STAGE_SHINGLE).view(">u8")[:, 0].astype(np.uint64)) if text else np.zeros(0, np.uint64)


def sketch(text: str | None) -> list[int]:
    """Columns SKETCH of a text: number of shingles, fingerprint, and block keys."""
    h = stage_shingles(text)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    print_ = int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0])
    keys = [0] * STAGE_BLOCKS
    if len(h):
        turns = np.arange(1, STAGE_BLOCKS * STAGE_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        least = np.array([mix(h ^ t).min() for t in turns])
        keys = [int(k) for k in np.bitwise_xor.reduce(mix(least.reshape(STAGE_BLOCKS, STAGE_ROWS) + turns.reshape(STAGE_BLOCKS, -1)), axis=1).view(np.int64)]
    return [len(h), print_, *keys]


@F.pandas_udf(SKETCH)
def sketch_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(t) for t in texts], columns=SKETCH.names)


def linked_texts(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `SIMILARITY` per cent or more."""
    if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) * (100 + SIMILARITY) >= (len(x) + len(y)) * SIMILARITY


@F.pandas_udf(T.BooleanType())
def linked_udf(first: pd.Series, second: pd.Series) -> pd.Series:
    # a text of a large block comes with several partners
    known = functools.lru_cache(256)(stage_shingles)
    return pd.Series([linked_texts(known(a), known(b)) for a, b in zip(first, second)], dtype=bool)


def stage_alike(a: Column, b: Column) -> Column:
    near = F.bit_count(a["bits"].bitwiseXOR(b["bits"])) <= STAGE_RADIUS
    return near & (100 * F.least(a["size"], b["size"]) >= SIMILARITY * F.greatest(a["size"], b["size"]))


def _open_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = [], []
        for one, x, y in zip(batch["one"], batch["first"], batch["second"]):
            x, y = (np.array([(v["id"], v["size"], v["bits"], v["label"]) for v in side], np.int64).reshape(-1, 4) for side in (x, y))
            i, j = bitslice.crossing(*(np.ascontiguousarray(side[:, 2]).view(np.uint64) for side in (x, y)), STAGE_RADIUS)
            u, v = x[i], y[j]
            fit = (100 * np.minimum(u[:, 1], v[:, 1]) >= SIMILARITY * np.maximum(u[:, 1], v[:, 1])) & (u[:, 3] != v[:, 3]) & (~np.bool_(one) | (u[:, 0] < v[:, 0]))
            a.append(np.minimum(u[fit, 0], v[fit, 0]))
            b.append(np.maximum(u[fit, 0], v[fit, 0]))
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def similar_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, size, group) for every row of `docs` (doc_id, text): rows of one group are linked by five-word shingles of similarity 0.8.

    Texts of equal words, told by a 64-bit hash, are one node. Blocks are bands of least shingle hashes; inside a block fingerprints are
    compared as bit planes, and pairs within the radius are checked on their whole shingle sets. Null and wordless texts are
    one group; a text of fewer than five words is one shingle; other columns aren't read; an empty table gives no rows.
    """
    marked = stored(docs.select("doc_id", words_id(F.col("text")).alias("id"), sketch_udf("text").alias("s")).select("doc_id", "id", "s.*"))
    nodes = marked.groupBy("id").agg(*[F.min(c).alias(c) for c in SKETCH.names])
    texts = docs.select(words_id(F.col("text")).alias("id"), "text")

    def compare(groups: DataFrame) -> DataFrame:
        return groups.select((F.col("i") == F.col("j")).alias("one"), "first", "second").mapInPandas(_open_pairs, "a long, b long").distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        return buckets.with_texts(pairs, texts).where(linked_udf("text_a", "text_b")).select("a", "b")

    classes = buckets.similar_classes(nodes, STAGE_KEYS, stage_alike, checked, compare)
    return marked.join(classes, marked["id"] == classes["node"], "left").select("doc_id", "size", F.coalesce("component", "id").alias("group"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its group of `similar_texts`; the columns stay as they are.

    A row without doc_id stays if no row with one is in its group. Rows that repeat a doc_id all stay
    or all go. Texts without words are one group.
    """
    groups = cut(similar_texts(docs))
    least = groups.groupBy("group").agg(F.min("doc_id").alias("least"))
    gone = groups.join(least, "group").where(F.coalesce(F.col("doc_id") != F.col("least"), F.col("least").isNotNull())).select(
        F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
