"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints at most `distance` bits apart are linked; every link is found. Two fingerprints that differ
in d bits agree on at least two of d + 2 bands of bits, so each distinct fingerprint goes to one bucket for
every pair of bands: these shared, masked bit patterns are the top nodes of the index. At 3 bits there are ten of
them with 25 or 26 bits each, so buckets stay small: 30 billion fingerprints fill them with about 600 each.
Inside a bucket fingerprints stand in Gray order, and runs of `FANOUT` neighbours are factored into nodes that hold the bits which all
members share (mask and pattern). A search goes down level by level, adds up the differences in the bits
that each level fixes, and drops whole groups once the sum exceeds the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, sliced, united, written
from .nearcopies import SIMILARITY, SIZE, near_copies

SEED = 42
FANOUT = 8
#: A bucket with more fingerprints is dealt out as pairs of blocks of this size.
BLOCK = 16384
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, size: int = 3, step: int = 1 << 20) -> int:
    """SimHash of the lower-cased ASCII words' shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return _hash(b" ".join(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, step):
        part = words[a : a + step + size - 1]
        m = min(step, n - a)
        h = np.fromiter(map(_hash, map(b" ".join, zip(*(part[k:] for k in range(size))))), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2000):
        texts = b.column("text").cast(pa.binary())
        fp = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, size), f"doc_id {kind}, fp long")


class GrayIndex:
    """Levels of (shared mask, pattern) over fingerprints sorted by bucket and Gray rank."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        n = len(fp)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        self.fp, self.bucket_no = fp, np.cumsum(np.r_[0, (bucket[1:] != bucket[:-1]).astype(np.int64)])
        lo, hi, no = np.arange(n), np.arange(1, n + 1), self.bucket_no
        low, high = fp, fp
        self.levels = [(lo, hi, fp, np.full(n, ~np.uint64(0)), None)]
        while len(low) > len(first):
            starts = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])
            at = np.arange(len(no)) - np.repeat(starts, np.diff(np.r_[starts, len(no)]))
            cut = np.flatnonzero(at % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            ends = np.r_[cut[1:], len(no)]
            lo, hi, no = lo[cut], hi[ends - 1], no[cut]
            shared = ~(low ^ high)
            self.levels.append((lo, hi, low & shared, shared, (cut, ends)))

    def near(self, rows: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, later row of its bucket) at most `distance` bits apart."""
        q, node = rows, self.bucket_no[rows]
        lo, hi, pattern, mask, _ = self.levels[-1]
        far = np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node]).astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            lo, hi, pattern, mask, kids = self.levels[k]
            stay = (far <= distance) & (hi[node] > q + 1)
            q, node, far = q[stay], node[stay], far[stay]
            if k == 0:
                return q, lo[node]
            a, b = kids[0][node], kids[1][node]
            n = b - a
            child = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, far, up = np.repeat(q, n), np.repeat(far, n), np.repeat(mask[node], n)
            _, _, below, own, _ = self.levels[k - 1]
            far = far + np.bitwise_count((self.fp[q] ^ below[child]) & own[child] & ~up)
            node = child
        raise AssertionError


def local_forest(bucket: np.ndarray, fp: np.ndarray, distance: int, budget: int = 1 << 21) -> np.ndarray:
    """For rows sorted by bucket and Gray rank: the first row of each row's component inside its bucket."""
    index, labels = GrayIndex(bucket, fp), np.arange(len(fp))
    cost = np.cumsum(np.bincount(index.bucket_no)[index.bucket_no])
    at = 0
    while at < len(fp):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + budget, "right")))
        labels = united(labels, *index.near(np.arange(at, end), distance))
        at = end
    return labels


def _forest(distance: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        first = local_forest(rows[0], rows[1].view(np.uint64), distance)
        joined = first != np.arange(len(first))
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[2][first[joined]]), pa.array(rows[2][joined])], names=["a", "b"]
        )

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "fp", "rep")])
        held.append(rows)
        if rows[0][0] == rows[0][-1] and (len(held) == 1 or held[0][0][0] == rows[0][0]):
            continue  # one bucket so far; its size is bounded by two blocks
        rows = np.concatenate(held, axis=1)
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        yield links(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield links(np.concatenate(held, axis=1))


def band_masks(distance: int) -> list[int]:
    """Masks, as signed 64-bit integers, of every pair of distance + 2 bands of bits."""
    bands = distance + 2
    cuts = [64 * k // bands for k in range(bands + 1)]
    mask = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    both = [mask[i] | mask[j] for j in range(bands) for i in range(j)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def near_links(reps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between reps(fp, rep) whose transitive closure is that of all pairs within `distance`.

    A bucket sends out a forest of at most its own size, never its pairs. Buckets above `block` are split
    into blocks by hash, and every pair of blocks is a task of its own, so that no task holds a hot bucket.
    """
    parts = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in band_masks(distance)])
    gray = F.col("fp")
    for k in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, k))
    keyed = reps.select("fp", "rep", gray.alias("gray"), F.posexplode(parts).alias("band", "bits"))
    keyed = keyed.select("fp", "rep", "gray", F.xxhash64("band", "bits").alias("key"))
    blocks = F.ceil(F.col("count") / block).cast("int").alias("blocks")
    hot = keyed.groupBy("key").count().where(F.col("count") > block).select("key", blocks)
    cold, last = F.col("blocks").isNull(), F.col("blocks") - 1
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int").alias("own")
    other = F.explode(F.when(cold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))).alias("other")
    dealt = keyed.join(hot, "key", "left").select("fp", "rep", "gray", "key", "blocks", own, other)
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    bucket = F.when(cold, F.xxhash64("key")).otherwise(pair)
    dealt = dealt.select(bucket.alias("bucket"), "fp", "rep", "gray")
    spread = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", "gray").drop("gray")
    return spread.mapInArrow(partial(_forest, distance), "a long, b long")


def simhash_dedup(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups of documents.

    component_id is the smallest doc_id that links reach, the document itself included. Null, empty and blank
    texts have fingerprint zero and link like any other; very long texts count whole; repeated rows stay rows of
    their own; rows with a null doc_id keep a fingerprint and take the component of equal fingerprints, null if none
    has an id. A bit that exactly half of the shingles have is 0. An empty table gives an empty result; other columns
    are ignored.
    """
    prints = written(fingerprints(docs, size), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    found = connected_components(near_links(reps, distance))
    groups = reps.join(found, reps["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(groups, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their group of near copies: those with its smallest doc_id.

    Texts link if the Jaccard similarity of their sets of `size`-word shingles reaches `similarity`; candidates are
    found by this module's index over the sets' fingerprints and by MinHash bands. Of repeated rows with the smallest
    doc_id one stays. Rows with a null doc_id cannot stand for a group, nor be named as members of one, and all stay.
    Null, empty and blank texts are copies of each other; very long texts count whole; an empty table stays empty.
    """
    reps, groups = near_copies(docs, size, similarity, near_prints=near_links)
    later = groups.where("node <> component").select(F.col("node").alias("rep"))
    keep = written(reps.join(later, "rep", "left_anti").select(F.col("rep").alias("doc_id")).distinct(), "kept")
    discard(reps, groups)
    rows = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where("doc_id is null")).select(*docs.columns)
