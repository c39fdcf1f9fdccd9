"""Hard negatives by exact integer products: anchors against all vectors in a residue number system.

Vectors become integers, and their components residues modulo a few small primes. A float32 matrix product of
residues is exact, as its sums stay below 2^24; Chinese remaindering gives the signed scores back. The anchors are
the stated queries: they are broadcast in slices of bounded size, rows are never shuffled, and a task keeps only the
best few rows of each anchor, so what leaves a task does not depend on the rows that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written

#: Positives of an anchor, and negatives of each of them.
KEEP = 5
#: Anchors of a slice at most, and components of all its vectors: 64 MB as integers.
SLICE, COMPONENTS = 16_384, 8_000_000
#: Rows and anchors of one product.
ROWS, ANCHORS = 2048, 1024
#: Components of one product at most; longer vectors are multiplied in parts.
DEPTH = 4096
#: Scores stay below this, so that a hundred times a score fits a long.
LARGEST = 2**50
_NONE = np.iinfo(np.int64).min


def primes_for(bound: int, depth: int) -> list[int]:
    """The largest primes whose residues multiply exactly in float32 over `depth` components, as many as it takes for
    signed values up to `bound`."""
    top = 2 * int((2**24 / max(1, min(depth, DEPTH))) ** 0.5) + 1
    found, product = [], 1
    for p in range(top, 2, -1):
        if product > 2 * bound:
            break
        if p % 2 and all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
    return found


def residues(v: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Of an integer matrix, for each prime: residues around zero."""
    return [((v + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integer products of all rows of a and b, given by their residues."""
    x, modulus = None, 1
    for p, left, right in zip(primes, a, b):
        r = np.zeros((len(left), len(right)), np.int64)
        for k in range(0, left.shape[1], DEPTH):
            r += (left[:, k : k + DEPTH] @ right[:, k : k + DEPTH].T).astype(np.int64)
        if x is None:
            x = r % p
        else:
            x += modulus * ((r - x) * pow(modulus, -1, p) % p)
        modulus *= p
    return np.where(x > modulus // 2, x - modulus, x)


class Best:
    """The first `k` (score, id) of each of several groups: higher scores first, ties by smaller id, ids once."""

    def __init__(self, groups: int, k: int):
        self.score = np.full((groups, k), _NONE, np.int64)
        self.id = np.zeros((groups, k), np.int64)
        self.k = k

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        own = np.unique(group)
        have = self.score[own] > _NONE
        g = np.r_[group, np.repeat(own, self.k)[have.ravel()]]
        s, i = np.r_[score, self.score[own][have]], np.r_[ids, self.id[own][have]]
        order = np.lexsort((-s, i, g))
        g, s, i = g[order], s[order], i[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
        g, s, i = g[first], s[first], i[first]
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        g, s, i, rank = (x[rank < self.k] for x in (g, s, i, rank))
        self.score[own] = _NONE
        self.score[g, rank], self.id[g, rank] = s, i

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, rank = np.nonzero(self.score > _NONE)
        return g, self.id[g, rank], self.score[g, rank]


class Anchors:
    """A slice of anchors: ids, labels, residues; later on their positives with the scores that bound negatives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, primes: list[int]):
        self.ids, self.labels, self.primes, self.width = ids, labels, primes, v.shape[1]
        self.residues = residues(v, primes)
        self.positive = np.zeros((len(ids), KEEP), np.int64)
        self.high = np.full((len(ids), KEEP), _NONE, np.int64)

    def with_positives(self, anchor: np.ndarray, rank: np.ndarray, ids: np.ndarray, score: np.ndarray) -> Anchors:
        at = np.searchsorted(self.ids, anchor)
        self.positive[at, rank], self.high[at, rank] = ids, score
        return self

    def scores(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return products([r[at] for r in self.residues], residues(v, self.primes), self.primes)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; what a shorter vector lacks is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _blocks(share, batches: Iterator[pa.RecordBatch]):
    """(ids, labels, vectors) of the rows, a bounded block at a time."""
    for b in sliced(batches, ROWS):
        v = _vectors(b.column("v"), share.width)
        yield b.column("vec_id").to_numpy(), b.column("label").to_numpy(), v


def _best_positives(share, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor_id, vec_id, score) of the best rows of each anchor's label in one task."""
    a = share.value
    best = Best(len(a.ids), KEEP)
    for ids, labels, v in _blocks(a, batches):
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            mine = np.flatnonzero(a.labels == label)
            for k in range(0, len(mine), ANCHORS):
                at = mine[k : k + ANCHORS]
                s = a.scores(at, v[rows])
                keep = (s >= best.score[at, -1][:, None]) & (a.ids[at][:, None] != ids[rows][None, :])
                x, y = np.nonzero(keep)
                best.add(at[x], s[x, y], ids[rows[y]])
    g, i, s = best.found()
    yield pa.RecordBatch.from_pydict({"anchor_id": a.ids[g], "vec_id": i, "score": s})


def _best_negatives(share, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor_id, positive_id, positive_score, vec_id, score) of the best rows in each positive's range of scores."""
    a = share.value
    best = Best(len(a.ids) * KEEP, KEEP)
    low = -((-4 * np.maximum(a.high, 0)) // 5)  # 80 p <= 100 n; a negative positive score leaves nothing
    for ids, labels, v in _blocks(a, batches):
        for k in range(0, len(a.ids), ANCHORS):
            at = np.arange(k, min(k + ANCHORS, len(a.ids)))
            s = a.scores(at, v)
            s[a.labels[at][:, None] == labels[None, :]] = _NONE
            for j in range(KEEP):
                group = at * KEEP + j
                least = np.maximum(low[at, j], best.score[group, -1])
                x, y = np.nonzero((s <= a.high[at, j][:, None]) & (s >= least[:, None]))
                best.add(group[x], s[x, y], ids[y])
    g, i, s = best.found()
    at, j = g // KEEP, g % KEEP
    yield pa.RecordBatch.from_pydict(
        {
            "anchor_id": a.ids[at], "positive_id": a.positive[at, j], "positive_score": a.high[at, j],
            "vec_id": i, "score": s
        }
    )


def _first(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first KEEP rows of each key among what the tasks found; rank counts from 1."""
    once = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEEP)


def integer_vectors(vectors: DataFrame, label: Column | str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v the components' floor(scale * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"),
        F.when(finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale))).alias("v"),
    )
    return rows.where("vec_id is not null and label is not null and v is not null").select(
        "vec_id", F.col("label").cast("long").alias("label"), "v"
    )


def hard_negatives(rows: DataFrame, anchors: Column, most: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, v).

    `anchors` says which rows are queries. An anchor's positives are its first five other rows of its label by integer
    product, ties by smaller vec_id; for each of them, negatives are the first five rows of other labels whose product is
    0.8 times the positive's to the positive's. All rows are compared; a table of anchors above `most` is read in
    slices, one after the other, each with its own two passes over the rows.

    Rows come from integer_vectors(): those with a null id, label, vector or component and those with a component that is
    not finite take no part. Shorter vectors are filled up with zeros, empty ones score zero. Rows that repeat a vec_id count
    once for an anchor, with their best score, and never as a partner of themselves; of an anchor's own repeats the
    one with the smallest (label, vector) asks. Without anchors or rows the result is empty. Further columns are not read, so
    names cannot clash. Vectors whose products may pass 2^50 raise an error.
    """
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    size, bound, n = rows.agg(F.max(F.size("v")), F.max(square), F.count_if(anchors)).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], shape)
    if bound >= LARGEST:
        raise ValueError("the products of these vectors do not fit: scale them down")
    primes = primes_for(int(bound) + 1, size)
    parts = -(-n // min(most, max(1, COMPONENTS // max(1, size))))
    asked = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    found = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "r.label", "r.v")
        got = own.toArrow().combine_chunks().sort_by("vec_id")
        if not got.num_rows:
            continue
        ids, labels = got["vec_id"].to_numpy(), got["label"].to_numpy()
        a = Anchors(ids, labels, _vectors(got["v"].combine_chunks(), size), primes)
        share = spark.sparkContext.broadcast(a)
        near = rows.mapInArrow(partial(_best_positives, share), "anchor_id long, vec_id long, score long")
        top = _first(near, ["anchor_id"]).toArrow()
        share.destroy()
        at = [top[c].to_numpy() for c in ("anchor_id", "rank", "vec_id", "score")]
        a = spark.sparkContext.broadcast(a.with_positives(at[0], at[1] - 1, *at[2:]))
        keys = ["anchor_id", "positive_id", "positive_score"]
        near = rows.mapInArrow(
            partial(_best_negatives, a), ", ".join(f"{c} long" for c in [*keys, "vec_id", "score"])
        )
        out = _first(near, keys).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")
        )
        if parts > 1:
            out = written(out, "negatives")
            a.destroy()
        found = out if found is None else found.union(out)
    return found
