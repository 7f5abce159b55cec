"""Vector code compression: product codes of integer vectors against integer codebooks.

Components become integers, so every distance, sum and mean is exact and doesn't depend on the
order in which tasks finish. The codebooks are small (`ENTRIES` entries of one vector's width)
and are broadcast; Arrow batches compute all distances to them by |x|^2 - 2 x.c + |c|^2 in int64
matrix products; a round's sums are merged inside each task first and then by one grouped shuffle
of at most (entries x components) rows from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import broadcast_if_few, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
ROWS = 2048             # of one matrix product
#: Components up to this size, and so their squares and sums over a vector of 2^20 of them, are exact in 64 bits.
LARGEST = 1 << 20

Codebooks = list[np.ndarray]


def usable(vector: str) -> Column:
    """True for vectors that are there and whose components all are finite numbers."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def part_bounds(width: int) -> list[int]:
    """Where the parts of a vector begin and end; equal parts if `PARTS` divides the width."""
    return [width * k // PARTS for k in range(PARTS + 1)]


def integers(vectors: pd.Series | list, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x); a power of two as scale makes the product exact in doubles."""
    flat = np.floor(np.concatenate([np.zeros(0), *vectors]).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > LARGEST * SCALE:
        raise ValueError(f"components beyond {LARGEST} can't be coded exactly")
    return flat.astype(np.int64).reshape(len(vectors), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the first of equals, and its squared distance."""
    squares = (x * x).sum(axis=1)
    d = squares[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def initial(vectors: DataFrame, width: int) -> Codebooks:
    """The parts of the vectors of the `ENTRIES` smallest ids; a bounded number of rows reaches the driver."""
    first = vectors.where("vec_id is not null").orderBy("vec_id", "vector").limit(ENTRIES).toPandas()
    x, cuts = integers(list(first["vector"]), width), part_bounds(width)
    return [x[:, a:b] for a, b in zip(cuts, cuts[1:])]


def moved(vectors: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Codebooks after one round: each entry the floored mean of its parts, unused entries as they were."""
    cuts = part_bounds(width)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros_like(b) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                x = integers(list(batch["vector"].iloc[low:low + ROWS]), width)
                for part, book in enumerate(shared.value):
                    piece = x[:, cuts[part]:cuts[part + 1]]
                    at, _ = nearest(piece, book)
                    np.add.at(totals[part], at, piece)
                    counts[part] += np.bincount(at, minlength=len(book))
        for part, (total, count) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(count)
            size = total.shape[1]
            yield pd.DataFrame({"part": part, "entry": used.repeat(size), "component": np.tile(np.arange(size), len(used)),
                                "total": total[used].ravel(), "n": count[used].repeat(size)})

    merged = vectors.select("vector").mapInPandas(sums, "part int, entry int, component int, total long, n long").groupBy(
        "part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    out = [b.copy() for b in books]
    for part, rows in merged.groupby("part"):
        out[part][rows["entry"], rows["component"]] = rows["total"] // rows["n"]
    return out


def fit(vectors: DataFrame, width: int) -> Codebooks:
    books = initial(vectors, width)
    for _ in range(ROUNDS):
        books = moved(vectors, books, width)
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(vec_id, label, code, error): the indexes as two hexadecimal digits each, the squared distances summed."""
    cuts = part_bounds(width)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, errors = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for low in range(0, len(batch), ROWS):
                x = integers(list(batch["vector"].iloc[low:low + ROWS]), width)
                for part, book in enumerate(shared.value):
                    at, distance = nearest(x[:, cuts[part]:cuts[part + 1]], book)
                    codes[low:low + ROWS, part] = at
                    errors[low:low + ROWS] += distance
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"].astype("Int64"),
                                "code": [c.tobytes().hex() for c in codes], "error": errors})

    return vectors.mapInPandas(rows, "vec_id long, label long, code string, error long")


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable row of `embeddings` (vec_id, embedding, label).

    Vectors that are null or hold a null or non-finite component are dropped. The width is that of
    the usable vector with the smallest id (of equal ids, the least vector); vectors of another width
    have no parts to compare and are dropped too. A width that `PARTS` doesn't divide is cut at
    floor(width * k / PARTS); vectors without components have the code of entry 0 throughout and no error.
    Fewer than `ENTRIES` usable rows give as many entries. Rows without id never seed a codebook but are
    coded; if no row has an id nothing can be coded and there are no rows. Repeated rows count and come out as often
    as they stand. Of equally near entries the first wins. A finite component beyond `LARGEST` is an error.
    Null labels are one group. Other columns aren't read.

    The table is scanned once for the seeds, once a round and once to code; only the codebooks and
    a round's sums, both bounded by the codebooks' size, reach the driver. The coded rows are written
    once, so that labels' sums and rows come from one table; label sums are broadcast only if they are counted to be few.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"),
                                F.col("label").cast("long")).where(usable("vector"))
    seed = vectors.where("vec_id is not null").orderBy("vec_id", "vector").select(F.size("vector")).first()
    if seed is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = seed[0]
    vectors = vectors.where(F.size("vector") == width)
    books = fit(vectors, width)
    rows = stored(coded(vectors, books, width))
    labels = broadcast_if_few(stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def compress_sql() -> str:
    """The same rows in SQL: sums of integers stay below 2^53, so doubles hold them exactly."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    books = "b0 AS (SELECT part, entry, list(x ORDER BY i) AS c FROM seeds GROUP BY part, entry)"
    near = """n{r} AS (SELECT v.vec_id, v.part, min((list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT * 256 + b.entry) AS best
  FROM pieces v JOIN b{r} b USING (part) GROUP BY ALL)"""
    step = f"""b{{k}} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{{r}} b LEFT JOIN (
  SELECT part, entry, list({floor_div} ORDER BY i) AS c FROM (
    SELECT w.part, (w.best % 256)::INT AS entry, p.i, sum(p.x)::BIGINT AS s, count(*) AS n FROM n{{r}} w JOIN parts p USING (vec_id, part) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""
    rounds = ",\n".join(near.format(r=r) + ",\n" + step.format(r=r, k=r + 1) for r in range(ROUNDS))
    return f"""WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, ((i - 1) * {PARTS}) // len(embedding) AS part, i, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
pieces AS (SELECT vec_id, part, list(x ORDER BY i) AS x FROM parts GROUP BY ALL),
seeds AS (SELECT p.*, s.entry FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) s USING (vec_id)),
{books},
{rounds},
{near.format(r=ROUNDS)},
codes AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best % 256), 2, '0')), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM codes c JOIN kept k USING (vec_id)"""
