"""Near copies of documents by the Jaccard similarity of their word shingles.

Documents are sets of 64-bit hashes of shingles; equal sets are one vertex. Candidates come from two indexes: the
SimHash fingerprints of the sets that the Gray-order index finds within 3 bits, and bands of MinHash values. The
first alone does not reach a similarity of 0.8, where fingerprints differ in about 10 of 64 bits, and an index of
that radius has bands of a few bits that hold everything. So candidates also agree in one of BANDS bands of ROWS
MinHash values (a pair at 0.8 is missed with a probability of (1 - 0.8 ** ROWS) ** BANDS, 5 in a million), where a
bucket links its members to its smallest one. Inside each component of these links, blocks of sets are joined exactly by
the prefixes of their rarest shingles, so texts that share a frame but no more are in one component and yet not
compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, sliced, united, written
from .neighbours import _groups

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 6
#: Shingles in a block of documents of one component, and shingles that are hashed at once.
BLOCK, PIECE = 1 << 21, 1 << 14
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_SEEDS = np.random.default_rng(8).integers(
    1, 1 << 32, size=(BANDS * ROWS, 2), dtype=np.uint64
).astype(np.uint32) | np.array([0, 1], np.uint32)


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased ASCII words' shingles; a shorter text, a blank one too, is one shingle."""
    words = (text or b"").lower().split()
    if len(words) < size:
        return np.array([_hash(b" ".join(words))], np.uint64)
    n = len(words) - size + 1
    return np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*(words[k:] for k in range(size))))), np.uint64, n))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each set one key a band, from the minima of ROWS hash orders."""
    flat, size = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.array([len(s) for s in sets])
    low = np.full((len(_SEEDS), len(sets)), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(size)
    for at in range(0, len(flat), PIECE):
        part = flat[at : at + PIECE]
        a, z = np.searchsorted(ends, [at, at + len(part) - 1], "right")
        starts = np.maximum(ends[a : z + 1] - size[a : z + 1] - at, 0)
        for k, (x, y) in enumerate(_SEEDS):
            np.minimum(low[k, a : z + 1], np.minimum.reduceat((part ^ x) * y, starts), out=low[k, a : z + 1])
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets))
    for row in range(ROWS):
        key = (key ^ low[row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.T


def simhash_of(shingles: np.ndarray, step: int = 1 << 20) -> int:
    """The bits that more than half of the shingle hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), step):
        part = shingles[a : a + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def _prints(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 500):
        sets = [shingle_set(t.as_py(), size) for t in b.column("text").cast(pa.binary())]
        digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        fp = pa.array([simhash_of(s) for s in sets], pa.int64())
        keys = pa.array(band_keys(sets).astype(np.uint64).view(np.int64).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), keys)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), digest, fp, bands], names=["doc_id", "digest", "fp", "bands"]
        )


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 500):
        sets = [shingle_set(t.as_py(), size) for t in b.column("text").cast(pa.binary())]
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("component"), b.column("doc_id"), n, pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["component", "doc_id", "n", "shingles"]
        )


def prefix_index(flat: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, bounds, members): groups of sets that share a shingle of their prefixes.

    flat holds the shingle numbers of sets one after the other. Ordered from rare to frequent, two sets of a similarity s share
    one of the first n - ceil(s n) + 1 shingles of each, so what many texts have in common, a page's frame
    say, brings no sets together. A set's entries are owners == its number; bounds are the group's places in members.
    """
    n = np.bincount(flat)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((rank[flat], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    short = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    head = order[place < np.repeat(short, size)]
    head = head[np.lexsort((owner[head], flat[head]))]
    token, members = flat[head], owner[head]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    count = np.diff(np.r_[start, len(token)])
    bounds = np.repeat(np.stack([start, start + count], 1), count, axis=0)[np.repeat(count, count) > 1]
    owners = members[np.repeat(count, count) > 1]
    by = np.argsort(owners, kind="stable")
    return owners[by], bounds[by], members


def joined(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For every set the first one of its component; pairs link from `similarity` up. Pairs that share a shingle of their
    prefixes, fit in size and are still apart are decided by their whole sets."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order])
    ends = np.cumsum(size)
    kinds, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    owners, bounds, members = prefix_index(flat, size, similarity)
    at = np.searchsorted(owners, np.arange(len(sets) + 1))
    mark, labels = np.zeros(len(kinds), bool), np.arange(len(sets))
    last = np.searchsorted(size, np.floor(size / similarity + 1e-9), "right")
    for i in np.unique(owners).tolist():
        near = np.unique(np.concatenate([members[x:z] for x, z in bounds[at[i] : at[i + 1]]]))
        near = near[(near > i) & (near < last[i])]
        near = near[labels[near] != labels[i]]
        if not len(near):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        parts = np.concatenate([flat[ends[k] - size[k] : ends[k]] for k in near])
        starts = np.cumsum(size[near]) - size[near]
        both = np.add.reduceat(mark[parts], starts, dtype=np.int64)
        mark[own] = False
        near = near[both / (size[i] + size[near] - both) >= similarity]
        labels = united(labels, np.full(len(near), i), near)
    first = np.arange(len(sets))
    np.minimum.at(low := np.full(len(sets), len(sets)), labels, order)
    first[order] = low[labels]
    return first


def _links(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "pair"):
        pair, ids = rows.column("pair").to_numpy(), rows.column("doc_id").combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]).tolist()
        first = np.concatenate([a + joined(sets[a:z], similarity) for a, z in zip(edge, [*edge[1:], len(sets)])])
        apart = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(first[apart])), ids.take(pa.array(apart))], names=["a", "b"]
        )


def near_copies(
    docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, block: int = BLOCK,
    near_prints: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reps of equal shingle sets, components of reps whose sets reach the similarity): rep and (node, component).

    `near_prints` links fingerprints, reps(fp, rep) to (a, b). A bucket sends a link for each member, never its pairs.
    Components of candidates above `block` shingles are split into blocks by hash, and every pair of blocks is
    decided apart. Rows with a null doc_id are left out.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, digest binary, fp long, bands array<long>"
    prints = written(docs.mapInArrow(partial(_prints, size), shape), "prints")
    first = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "bands")).alias("first"))
    equal = written(first.select("first.doc_id", "first.fp", "first.bands"), "sets")
    discard(prints)
    keyed = equal.select(F.explode("bands").alias("key"), F.col("doc_id").alias("b"))
    shared = keyed.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    star = keyed.join(shared, "key").where("a <> b").select("a", "b")
    if near_prints is not None:
        reps = equal.groupBy("fp").agg(F.min("doc_id").alias("rep"))
        same = equal.join(reps, "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        star = star.union(same).union(near_prints(reps))
    found = connected_components(star).withColumnRenamed("node", "doc_id")
    sets = docs.join(found, "doc_id").select("component", "doc_id", "text")
    shape = f"component {kind}, doc_id {kind}, n long, shingles binary"
    sets = written(sets.mapInArrow(partial(_sets, size), shape), "shingles")
    blocks = sets.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.join(blocks, "component").select("component", "doc_id", "shingles", own, other)
    pair = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("pair")
    spread = dealt.select(pair, "doc_id", "shingles").repartition(F.col("pair")).sortWithinPartitions("pair")
    groups = connected_components(spread.mapInArrow(partial(_links, similarity), f"a {kind}, b {kind}"))
    discard(sets)
    return equal.select(F.col("doc_id").alias("rep")), groups
