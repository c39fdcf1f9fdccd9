"""Embedding near-duplicates by NN-descent.

A neighbour graph over the distinct vectors of each label starts from chunks of vectors sorted by random
hyperplane signatures and is refined by joining neighbours of neighbours; a list whose entries all reach the
threshold is saturated and doubles its length. The candidates use vectors rounded to bytes; every link is
then decided in double precision.

Lists that are still saturated at the end may lack links. Their vectors are covered by balls around some of
them, and the balls of different components meet: by the triangle inequality two balls can only hold a link
if the angle of their centres is within the threshold's angle and both radii, and such pairs of balls are
compared vector by vector. So saturated vectors keep their components whole however long the lists would have to be, and
inside each component all cosines are taken block by block. A vector whose list is not full may still lack a link that the
descent has missed; the audit measures that.

An audit against brute force measures recall, asks for more rounds if it is low, and in the end raises an error
rather than return a result below LEAST.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, written

#: Lists start with K entries and grow to LONGEST; TABLES signatures of BITS; chunks and blocks of vectors.
K, LONGEST, TABLES, BITS, CHUNK, BLOCK = 8, 64, 6, 24, 192, 1024
#: Ball centres that are compared at once.
CENTRES = 4096
#: Rounded cosines are within SLACK of the true ones for all practical purposes.
SLACK = 0.02
#: Vectors in the audit, the recall that ends the refinement, and the least that is returned at all.
AUDITED, WANTED, LEAST = 256, 0.97, 0.9
_LOG = logging.getLogger(__name__)
_PAIR = "a long, b long"


def _grid(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.max(np.abs(x), axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _mixed(ids: np.ndarray, table: int) -> np.ndarray:
    """Another order of the ids for each table, which deals vectors of one signature to other chunks each time."""
    h = (ids.astype(np.uint64) + np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * table)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _sign(tables: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, tab, sig, tie, id, q): a row for each table, with the unit vector rounded to bytes."""
    for b in batches:
        group, ids, vectors = b.column("grp").to_numpy(), b.column("id").to_numpy(), b.column("v")
        size = vectors.value_lengths().to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            unit = _unit(_grid(vectors.take(pa.array(at))))
            planes = np.random.default_rng(d).standard_normal((d, tables * bits))
            side = (unit @ planes > 0).reshape(len(at), tables, bits)
            sig = side @ (1 << np.arange(bits, dtype=np.int64)[::-1])
            q = np.rint(unit * 127).astype(np.int8)
            rounded = pa.array([x.tobytes() for x in q], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group[at]), pa.array(np.full(len(at), t, np.int32)), pa.array(sig[:, t]),
                        pa.array(_mixed(ids[at], t)), pa.array(ids[at]), rounded,
                    ],
                    names=["grp", "tab", "sig", "tie", "id", "q"],
                )


def _bytes(column: pa.Array) -> np.ndarray:
    """Equally long byte strings as rows of float32 between -1 and 1."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1).astype(np.float32) / 127


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()


def _columns(parts: list[tuple], kinds: dict[str, type]) -> pa.RecordBatch:
    """Arrays found in several places as one batch."""
    arrays = [
        np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind)
        for k, kind in enumerate(kinds.values())
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=list(kinds))


_LISTED = {"id": np.int64, "nbr": np.int64, "sim": np.float32}


def _edges_of(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(first row, row after) of every run of equal keys."""
    new = np.zeros(len(keys[0]) - 1 if len(keys[0]) else 0, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edge = [0, *(np.flatnonzero(new) + 1).tolist()] if len(keys[0]) else []
    return list(zip(edge, [*edge[1:], len(keys[0])]))


def _chunked(k: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        group, table, ids = (b.column(c).to_numpy() for c in ("grp", "tab", "id"))
        parts = []
        for a, z in _edges_of(group, table):
            for x in range(a, z, chunk):
                y = min(z, x + chunk)
                if y - x > 1:
                    v = _bytes(b.column("q").slice(x, y - x))
                    parts.append(_top(ids[x:y], v @ v.T, k))
        yield _columns(parts, _LISTED)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of all rows of one or several whole keys, from rows in order of the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if held[0].column(key)[0] == b.column(key)[b.num_rows - 1]:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        yield rows.slice(0, cut)
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a common vertex as candidates for each other, where they improve a list."""
    for rows in _groups(batches, "at"):
        rows = rows.combine_chunks()
        at, ids, least = (rows.column(c).to_numpy() for c in ("at", "id", "least"))
        q = rows.column("q").chunk(0)
        parts = []
        for a, z in _edges_of(at):
            if z - a < 2:
                continue
            v = _bytes(q.slice(a, z - a))
            s = v @ v.T
            np.fill_diagonal(s, -2)
            i, j = np.nonzero(s > least[a:z, None])
            parts.append((ids[a:z][i], ids[a:z][j], s[i, j]))
        yield _columns(parts, _LISTED)


def _saturated(threshold: float):
    """Whether a list is full and all of it reaches the threshold, so that more may be beyond its end."""
    return (F.size("nbrs") >= F.col("size")) & (F.element_at("nbrs", -1)["sim"] >= threshold - SLACK)


def _merge(candidates: DataFrame, wanted: DataFrame | None, threshold: float) -> DataFrame:
    """(id, nbrs, size, full): each id's best distinct candidates, as many as its list may hold."""
    best = candidates.groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LONGEST)
    lists = best.groupBy("id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("sim", "nbr")))).alias("nbrs"))
    if wanted is None:
        lists = lists.withColumn("size", F.lit(K))
    else:
        lists = lists.join(wanted, "id", "left").withColumn("size", F.coalesce("size", F.lit(K)))
    lists = lists.withColumn("nbrs", F.slice("nbrs", 1, F.col("size"))).withColumn("full", _saturated(threshold))
    return lists.withColumn(
        "size", F.when(F.col("full"), F.least(F.col("size") * 2, F.lit(LONGEST))).otherwise(F.col("size"))
    )


def _refine(graph: DataFrame, rounded: DataFrame, threshold: float) -> DataFrame:
    """One NN-descent round: a vertex's neighbours, and some vertices that list it, meet at it."""
    links = graph.select("id", F.inline("nbrs"))
    listed = links.select(F.col("id").alias("at"), F.col("nbr").alias("id"))
    drawn = Window.partitionBy("nbr").orderBy(F.xxhash64("id", "nbr"), "id")
    back = links.withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= 2 * K)
    met = listed.union(back.select(F.col("nbr").alias("at"), "id")).union(graph.select(F.col("id").alias("at"), "id"))
    last = F.when(F.size("nbrs") < F.col("size"), F.lit(-1.0)).otherwise(F.element_at("nbrs", -1)["sim"])
    least = graph.select("id", last.cast("float").alias("least"))
    carried = rounded.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0).cast("float")))
    rows = met.distinct().join(carried, "id").select("at", "id", "least", "q")
    new = rows.repartition(F.col("at")).sortWithinPartitions("at").mapInArrow(_around, "id long, nbr long, sim float")
    return _merge(links.select("id", "nbr", "sim").union(new), graph.select("id", "size"), threshold)


def _decide(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = b.column("va"), b.column("vb")
        size = a.value_lengths().to_numpy()
        keep = np.zeros(b.num_rows, bool)
        for d in np.unique(size):
            at = pa.array(np.flatnonzero(size == d))
            keep[at.to_numpy()] = (_unit(_grid(a.take(at))) * _unit(_grid(z.take(at)))).sum(axis=1) >= threshold
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def _linked(graphs: list[DataFrame], points: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among all listed pairs, decided in double precision."""
    pairs = None
    for g in graphs:
        own = g.select("id", F.inline("nbrs")).where(F.col("sim") >= threshold - SLACK)
        own = own.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"))
        pairs = own if pairs is None else pairs.union(own)
    vector = points.select("id", "v")
    both = pairs.distinct().join(vector.toDF("a", "va"), "a").join(vector.toDF("b", "vb"), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(partial(_decide, threshold), _PAIR)


def _balls(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, id, angle): vectors of one component within the threshold of a centre, which names the ball."""
    for b in batches:
        component, ids, vectors = b.column("component").to_numpy(), b.column("id").to_numpy(), b.column("v")
        parts = []
        for a, z in _edges_of(component):
            for x in range(a, z, BLOCK):
                y = min(z, x + BLOCK)
                unit = _unit(_grid(vectors.slice(x, y - x)))
                left = np.arange(y - x)
                while len(left):
                    cosine = np.clip(unit[left] @ unit[left[0]], -1, 1)
                    cosine[0] = 1.0
                    inside = cosine >= threshold
                    members = left[inside]
                    parts.append((np.full(len(members), ids[x + left[0]]), ids[x + members], np.arccos(cosine[inside])))
                    left = left[~inside]
        yield _columns(parts, {"ball": np.int64, "id": np.int64, "angle": np.float64})


def _near_balls(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of balls of different components that may hold a link."""
    reach = np.arccos(threshold) + 1e-6
    for rows in _groups(batches, "pair"):
        rows = rows.combine_chunks()
        pair, ball, component, side, radius = (
            rows.column(c).to_numpy() for c in ("pair", "ball", "component", "block", "radius")
        )
        vectors, parts = rows.column("v").chunk(0), []
        for a, z in _edges_of(pair):
            unit, part = _unit(_grid(vectors.slice(a, z - a))), side[a:z]
            first = np.flatnonzero(part == part.min())
            second = np.flatnonzero(part == part.max())
            angle = np.arccos(np.clip(unit[first] @ unit[second].T, -1, 1))
            near = angle <= reach + radius[a:z][first][:, None] + radius[a:z][second][None]
            near &= component[a:z][first][:, None] != component[a:z][second][None]
            if part.min() == part.max():
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            parts.append((ball[a:z][first[i]], ball[a:z][second[j]]))
        yield _columns(parts, {"a": np.int64, "b": np.int64})


def _bridge(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link between the two balls of each pair, if they have any."""
    for rows in _groups(batches, "pair"):
        rows = rows.combine_chunks()
        pair, ids, side = (rows.column(c).to_numpy() for c in ("pair", "id", "second"))
        vectors, parts = rows.column("v").chunk(0), []
        for a, z in _edges_of(pair):
            unit, second = _unit(_grid(vectors.slice(a, z - a))), side[a:z].astype(bool)
            if second.all() or not second.any():
                continue
            cosine = unit[~second] @ unit[second].T
            i, j = np.unravel_index(int(cosine.argmax()), cosine.shape)
            if cosine[i, j] >= threshold:
                parts.append((ids[a:z][~second][[i]], ids[a:z][second][[j]]))
        yield _columns(parts, {"a": np.int64, "b": np.int64})


def _bridged(graph: DataFrame, found: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """The components, those joined into one that links of vectors with saturated lists hold together.

    A vector whose list is not saturated has all of its links listed, so missing ones have such vectors at both
    ends. A pair of balls is compared in one task: both are parts of blocks of BLOCK vectors.
    """
    spark = graph.sparkSession
    full = graph.where("full").select("id").join(found.withColumnRenamed("node", "id"), "id")
    full = written(full.join(points.select("id", "grp", "v"), "id"), "saturated")
    if full.select("component").distinct().limit(2).count() < 2:
        discard(full)
        return found
    order = full.repartitionByRange(F.col("grp"), F.col("component"), F.col("id"))
    order = order.sortWithinPartitions("grp", "component", "id")
    balls = written(order.mapInArrow(partial(_balls, threshold), "ball long, id long, angle double"), "balls")
    members = balls.select("ball", "id").join(full.select("id", "v"), "id")
    centres = balls.groupBy("ball").agg(F.max("angle").alias("radius"))
    centres = centres.join(full.select(F.col("id").alias("ball"), "grp", "component", "v"), "ball")
    blocks = full.groupBy("grp").count().select("grp", F.ceil(F.col("count") / CENTRES).cast("int").alias("blocks"))
    dealt = centres.join(F.broadcast(blocks) if blocks.count() < 10_000 else blocks, "grp")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    dealt = dealt.select(pair, "ball", "component", "block", "radius", "v").repartition(F.col("pair"))
    near = dealt.sortWithinPartitions("pair").mapInArrow(partial(_near_balls, threshold), _PAIR).distinct()
    near = written(near.withColumn("pair", F.monotonically_increasing_id()), "near_balls")
    sides = [
        near.select("pair", F.col(c).alias("ball"), F.lit(k).alias("second")) for k, c in enumerate(("a", "b"))
    ]
    meet = sides[0].union(sides[1]).join(members, "ball").select("pair", "id", "second", "v").repartition(F.col("pair"))
    links = written(meet.sortWithinPartitions("pair").mapInArrow(partial(_bridge, threshold), _PAIR), "bridges")
    name = found.select("node", "component")
    joined = links.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b").select(
        F.col("ca").alias("a"), F.col("cb").alias("b")
    )
    renamed = connected_components(joined.where("a <> b")).toDF("component", "into")
    out = found.join(renamed, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    out = written(out, "components")
    discard(full, balls, near, links, renamed, found)
    return out


def _within(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each vector to the other vectors of its pair of blocks."""
    for rows in _groups(batches, "pair"):
        rows = rows.combine_chunks()
        pair, ids, block, copies = (rows.column(c).to_numpy() for c in ("pair", "id", "block", "copies"))
        vectors, parts = rows.column("v").chunk(0), []
        for a, z in _edges_of(pair):
            unit, side = _unit(_grid(vectors.slice(a, z - a))), block[a:z]
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if (side != side[0]).any():
                near &= side[:, None] != side[None, :]
            parts.append((ids[a:z], near @ copies[a:z]))
        yield _columns(parts, {"id": np.int64, "n": np.int64})


def _counted(found: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(id, n): links of each vertex to other vertices, from all pairs of blocks of its component; written."""
    size = found.groupBy("component").count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    member = found.join(size, "component").select(
        F.col("node").alias("id"), "component", blocks.alias("blocks"), own.alias("block")
    )
    member = member.join(points.select("id", "v", "copies"), "id")
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    dealt = dealt.select(pair, "id", "block", "v", "copies").repartition(F.col("pair")).sortWithinPartitions("pair")
    counts = dealt.mapInArrow(partial(_within, threshold), "id long, n long")
    return written(counts.groupBy("id").agg(F.sum("n").alias("n")), "links")


def _audit(sample, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute-force link counts of the sample, summed over each batch."""
    probes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for pid, group, v in sample.value:
        probes.setdefault((group, len(v)), ([], []))
        probes[group, len(v)][0].append(pid)
        probes[group, len(v)][1].append(v)
    for b in batches:
        group, ids, copies = (b.column(c).to_numpy() for c in ("grp", "id", "copies"))
        vectors, parts = b.column("v"), []
        size = vectors.value_lengths().to_numpy()
        for (g, d), (pid, v) in probes.items():
            at = np.flatnonzero((group == g) & (size == d))
            if len(at):
                near = _unit(np.array(v)) @ _unit(_grid(vectors.take(pa.array(at)))).T >= threshold
                near &= np.array(pid)[:, None] != ids[at][None]
                parts.append((pid, near @ copies[at]))
        yield _columns(parts, {"id": np.int64, "n": np.int64})


def _probes(graph: DataFrame, points: DataFrame, threshold: float) -> list[tuple[int, int, np.ndarray]]:
    """The audit's vectors: half of those with a likely link, the others of all, in order of hashed ids."""
    order = (F.xxhash64("id"), F.col("id"))
    likely = graph.where(F.element_at("nbrs", 1)["sim"] >= threshold - SLACK).select("id")
    drawn = [x.orderBy(*order).limit(AUDITED // 2) for x in (likely, points.select("id"))]
    rows = points.join(F.broadcast(drawn[0].union(drawn[1]).distinct()), "id").select("id", "grp", "v").collect()
    return [(r.id, r.grp, np.array(r.v, np.float64)) for r in rows]


def _recall(links: DataFrame, true: dict[int, int]) -> tuple[float, float]:
    """(share of the audited vectors' links that were found, share of vectors with the right number)."""
    own = {r.id: r.n for r in links.where(F.col("id").isin(list(true))).collect()} if true else {}
    total = sum(true.values())
    return (
        sum(min(n, own.get(i, 0)) for i, n in true.items()) / total if total else 1.0,
        sum(own.get(i, 0) == n for i, n in true.items()) / len(true) if true else 1.0,
    )


def near_vectors(rows: DataFrame, threshold: float = 0.98, rounds: int = 2, most: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) per row of rows(vec_id, embedding, label).

    Vectors of equal, non-null labels and equal length link if their cosine reaches the threshold. A vector
    that is null, empty or zero or holds nulls, NaN or infinities links with nothing, and neither does one
    without a label or vec_id. Equal vectors of a label are one vertex that counts once per distinct vec_id; a
    vec_id with several vectors is a vertex for each, and its rows tell the links of their own vectors. Repeated
    rows come out alike, ties of equal cosines change nothing, other columns are ignored, and an empty table
    gives an empty result. audit_recall is the measured share of found links, the same on every row; below
    LEAST an error is raised instead.
    """
    rows = rows.select("vec_id", "embedding", "label")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    usable &= F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("label", "embedding")))
    points = rows.where("key is not null").groupBy("key", "label", "embedding")
    points = points.agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("copies"))
    points = points.select(
        F.monotonically_increasing_id().alias("id"), "key", "label", "embedding", "first", "copies",
        F.xxhash64("label", F.size("embedding")).alias("grp"), F.col("embedding").alias("v"),
    )
    points = written(points, "points")
    shape = "grp long, tab int, sig long, tie long, id long, q binary"
    signed = written(points.select("grp", "id", "v").mapInArrow(partial(_sign, TABLES, BITS), shape), "signed")
    order = ("grp", "tab", "sig", "tie")
    chunks = signed.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    listed = chunks.mapInArrow(partial(_chunked, K, CHUNK), "id long, nbr long, sim float")
    graph = start = written(_merge(listed, None, threshold), "graph")
    rounded = signed.where("tab = 0").select("id", "q")
    probes = points.sparkSession.sparkContext.broadcast(_probes(start, points, threshold))
    true = points.mapInArrow(partial(_audit, probes, threshold), "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")
    )
    true = {r.id: r.n for r in true.collect()}
    probes.unpersist()
    for k in range(most):
        graph_next = written(_refine(graph, rounded, threshold), "graph")
        if graph is not start:
            discard(graph)
        graph = graph_next
        if k + 1 < rounds:
            continue
        found = connected_components(_linked([start, graph], points, threshold))
        found = _bridged(graph, found, points, threshold)
        links = _counted(found, points, threshold)
        recall, right = _recall(links, true)
        _LOG.info("round %d: %.4f of audited links found, %.4f of vectors right", k + 1, recall, right)
        if min(recall, right) >= WANTED or k + 1 == most:
            break
        discard(found, links)
    discard(start, graph, signed)
    if recall < LEAST:
        raise RuntimeError(f"after {most} rounds the audit finds {recall:.3f} of the links, below {LEAST}")
    named = found.join(points.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(
        F.min("first").alias("name")
    )
    ends = points.join(found, points["id"] == found["node"], "left").join(links, "id", "left").join(
        named, "component", "left"
    )
    ends = ends.select(
        "key", "label", "embedding", F.coalesce("name", "first").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    e, r = ends.alias("e"), rows.alias("r")
    equal = (F.col("r.key") == F.col("e.key")) & (F.col("r.label") == F.col("e.label"))
    same = r.join(e, equal & (F.col("r.embedding") == F.col("e.embedding")), "left")
    component = F.coalesce(F.col("e.component"), F.col("r.vec_id")).cast("long")
    return same.select(
        F.col("r.vec_id").alias("vec_id"), F.coalesce(F.col("e.n_links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("r.vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).alias("audit_recall"),
    )
