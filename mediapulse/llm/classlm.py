"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

All counts cover all training documents, and every word of them has a class; the number of classes grows with
the vocabulary. Clustering starts with few words and ends with all: the SEED most frequent words are clustered by the
exchange algorithm until the likelihood settles; then all words are exchanged in rounds over their neighbours among
the CORE most frequent words, which are counted once in a table that is dealt by word, until the likelihood
settles. Then the last round looks at the classes of all neighbours of every word, counted over all texts, and so places
every word. In a round each word moves to the class where its neighbours' likelihood is greatest under the counts of
the classes before it. A text's probability is the product of class transitions and word emissions, both
smoothed; a class gives the unknown word the weight of its words seen once, so that the probabilities of all
known words, of the text end and of the unknown word sum to one after any history.

Texts are tokenised to count words, to count neighbours among the core, to count all neighbours' classes, and to turn them into classes. The words
of a broadcast dictionary (the HEAD most frequent) find their class at once, all others by a join with the same
result; transitions and scores are taken from the table of classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sliced, written
from .neighbours import _groups

#: Words that classes start with, words of the first exchange, and words of the broadcast dictionary with at most
#: LONGEST bytes. These bound what tasks hold; the last round sees all words and all their neighbours.
CORE, SEED, HEAD, LONGEST = 4000, 1000, 200_000, 64
#: Smoothing of transitions, and the relative gains in likelihood below which the first exchange and the rounds over
#: core neighbours have settled.
STRENGTH, FIRST, SETTLED = 20.0, 1e-4, 0.01
#: Bits of a key of the table of neighbours that hold the neighbour.
_BITS = 16
#: Columns of the neighbours that a task has counted.
_CELLS = ["word_key", "x", "n", "side", "other", "m"]
_LISTS = "word_key long, x binary, n binary"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def n_classes(n_words: int) -> int:
    """Classes for a vocabulary: about 40 for 300,000 words, 400 for 300 million."""
    return max(2, min(n_words, round(0.6 * n_words ** (1 / 3))))


def word_key(word: bytes) -> int:
    """The upper 47 bits of a word's hash; words that share it (2 in 10^14 pairs) share their neighbours."""
    return xxhash.xxh64_intdigest(word, seed=42) >> 17


def _key_of(column):
    return F.shiftrightunsigned(F.xxhash64(column), 17)


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[list[list[bytes]]]:
    """Token lists of some texts at a time."""
    held, n = [], 0
    for b in batches:
        for t in b.column("text").cast(pa.binary()):
            text = t.as_py()
            held.append(tokens(text))
            n += len(text or b"")
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(c: Counter) -> pa.RecordBatch:
        words, n = pa.array(list(c), pa.binary()).view(pa.string()), pa.array(list(c.values()), pa.int64())
        return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    counts: Counter = Counter()
    for texts in _pieces(batches):
        for words in texts:
            counts.update(words)
        if len(counts) > 250_000:
            yield rows(counts)
            counts = Counter()
    if counts:
        yield rows(counts)


def _named(words: list[bytes], name: np.ndarray) -> dict:
    """What `_neighbours` broadcasts: numbers of frequent words, and the keys and names (or -1) of the numbers."""
    return {
        "number": {w: k for k, w in enumerate(words)}, "name": np.asarray(name, np.int64),
        "key": np.fromiter(map(word_key, words), np.int64, len(words))
    }


def _lists(keys: np.ndarray, n: np.ndarray | None = None) -> list[pa.Array]:
    """(word_key, x, n): a row for each word, from the keys of its cells, of which each counts once or n times. The cells
    go as two bytes a cell in x and four bytes a count in n, so that they are shuffled and sorted by word and not by cell."""
    if n is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n = np.diff(np.r_[at, len(keys)]) if n is None else np.add.reduceat(n, at)
    keys = keys[at]
    word = keys >> _BITS
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    ends = np.r_[starts, len(word)]
    return [
        pa.array(word[starts]), _binaries((keys & ((1 << _BITS) - 1)).astype("<u2"), ends), _binaries(n.astype("<u4"), ends)
    ]


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and where each row's begin, with the end after the last."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return values, (ends - ends[0]) // values.itemsize


def _neighbours(named, width: int, others: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by word key and neighbour as lists (word_key, x, n). x is what the neighbour's name stands for, or
    width - 1 for the text end; right ones have `width` added. If `others` count, neighbours without a name are rows
    (word_key, side, other, m) with their own key in `other`; else they are left out."""
    number, key_of, name_of = (named.value[k] for k in ("number", "key", "name"))

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        arrays = _lists(np.concatenate(held))
        if others:
            arrays += [pa.nulls(len(arrays[0]), t) for t in (pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=_CELLS[: len(arrays)])

    def rest(side: int, word: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((other, word))
        word, other = word[order], other[order]
        at = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (other[1:] != other[:-1])])
        m, none = np.diff(np.r_[at, len(word)]), pa.nulls(len(at), pa.binary())
        arrays = [pa.array(word[at]), none, none, pa.array(np.full(len(at), side, np.int32)), pa.array(other[at])]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(m)], names=_CELLS)

    held, n = [], 0
    for texts in _pieces(batches):
        flat = [b"", *chain.from_iterable((*words, b"") for words in texts)]  # no word is empty: the text end
        code = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        word, known = np.ones(len(flat), bool), np.flatnonzero(code >= 0)
        word[np.r_[0, np.cumsum(size + 1)]] = False
        rare = np.flatnonzero((code < 0) & word)
        key, name = np.zeros(len(flat), np.int64), np.where(word, -1, width - 1)
        key[known], name[known] = key_of[code[known]], name_of[code[known]]
        key[rare] = np.fromiter(map(word_key, [flat[k] for k in rare.tolist()]), np.int64, len(rare))
        left, right = slice(None, -1), slice(1, None)
        for side, w, x in ((0, right, left), (width, left, right)):
            at = word[w] & (name[x] >= 0)
            held.append(key[w][at] << _BITS | (side + name[x][at]))
            n += len(held[-1])
            at = word[w] & (name[x] < 0)
            if others and at.any():
                yield rest(side, key[w][at], key[x][at])
        if n > 4_000_000:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (word_key, x, n) from rows (key, n) of single cells."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "n"))
        return pa.RecordBatch.from_arrays(_lists(key, n), names=_CELLS[:3])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > 1_000_000:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def exchange(pairs: np.ndarray, classes: int, settled: float = 0.0) -> np.ndarray:
    """Classes of words from their bigram counts (the last row and column are the text end, which stays alone).

    Words start round robin by frequency; each pass takes every word out of its class and puts it where the
    likelihood, the sum of f(class pairs) - 2 f(classes) with f(x) = x log x, grows most. The end is reached when
    no word moves, or when a pass gains no more than `settled` of the likelihood.
    """
    n = len(pairs) - 1
    own = np.r_[np.arange(n) % max(1, classes), classes]
    hot = np.zeros((n + 1, classes + 1))
    hot[np.arange(n + 1), own] = 1
    right, left = pairs @ hot, pairs.T @ hot
    grid = hot.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    every, gained = np.arange(classes + 1), np.inf
    while gained > settled * abs(f(grid).sum() - f(grid.sum(axis=0)).sum() - f(grid.sum(axis=1)).sum()):
        gained = 0.0
        for w in range(n):
            c, r, l, self_pair = own[w], right[w].copy(), left[w].copy(), pairs[w, w]
            r[c] -= self_pair
            l[c] -= self_pair
            grid[c] -= r
            grid[:, c] -= l
            grid[c, c] -= self_pair
            row, col = grid.sum(axis=1) + l, grid.sum(axis=0) + r
            gain = (f(grid + r) - f(grid)).sum(axis=1) + (f(grid + l[:, None]) - f(grid)).sum(axis=0)
            corner = grid[every, every]
            gain += f(corner + r + l + self_pair) - f(corner + r) - f(corner + l) + f(corner)
            out, into = r.sum() + self_pair, l.sum() + self_pair
            gain -= f(row + out) - f(row) + f(col + into) - f(col)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[c] + 1e-9 * (1 + abs(gain[c])):
                best = c
            grid[best] += r
            grid[:, best] += l
            grid[best, best] += self_pair
            if best != c:
                own[w] = best
                right[:, c] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, c] -= pairs[w]
                left[:, best] += pairs[w]
                gained += gain[best] - gain[c]
    return own


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """log P(neighbour class | class) from counts by (class, neighbour class), smoothed by the neighbours' shares."""
    share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
    return np.log((counts + share) / (counts.sum(axis=1, keepdims=True) + 1))


def choose(
    starts: np.ndarray, neighbour: np.ndarray, n: np.ndarray, log_p: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(class of greatest likelihood, that likelihood) of words, whose rows begin at `starts`; ties go to the first.

    Some words at a time are a dense matrix of counts by neighbour class, which is multiplied by the classes'.
    """
    width, ends = log_p.shape[1], np.r_[starts[1:], len(neighbour)]
    by_neighbour = np.ascontiguousarray(log_p.T.astype(np.float32))
    best, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.float32)
    for a in range(0, len(starts), 4096):
        z = min(len(starts), a + 4096)
        rows = slice(starts[a], ends[z - 1])
        cell = np.repeat(np.arange(z - a) * width, ends[a:z] - starts[a:z]) + neighbour[rows]
        counts = np.bincount(cell, weights=n[rows], minlength=(z - a) * width).astype(np.float32)
        total = counts.reshape(z - a, width) @ by_neighbour
        best[a:z] = total.argmax(axis=1)
        value[a:z] = total[np.arange(z - a), best[a:z]]
    return best, value


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word, from rows in order of words; a neighbour counted by several tasks stands there several times."""
    for table in _groups(batches, "word_key"):
        table = table.combine_chunks()
        word = table.column("word_key").to_numpy()
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lists = []
        for name, kind in (("x", "<u2"), ("n", "<u4")):
            for chunk in table.column(name).chunks:
                values, starts = _values(chunk, kind)
                lists.append(_binaries(values, np.r_[starts[first], starts[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(word[first]), *lists], names=_CELLS[:3])


def _assign(log_p: np.ndarray, class_of: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, likelihood, counts): every word's best class; a row without a word has the task's counts by
    (class, neighbour class) under the new classes of words and the old ones of their neighbours."""
    kinds, width = log_p.shape
    grid = np.zeros((kinds, width), np.int64)

    def rows(word: np.ndarray, best: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(word), pa.list_(pa.int64()))
        arrays = [pa.array(word), pa.array(best.astype(np.int32)), pa.array(value.astype(np.float64)), none]
        return pa.RecordBatch.from_arrays(arrays, names=["word_key", "class", "value", "counts"])

    for b in batches:
        x, starts = _values(b.column("x"), "<u2")
        neighbour, n = class_of[x], _values(b.column("n"), "<u4")[0]
        if not len(n):
            continue
        best, value = choose(starts[:-1], neighbour, n, log_p)
        own = np.repeat(best, np.diff(starts)) * width + neighbour
        grid += np.bincount(own, weights=n, minlength=kinds * width).astype(np.int64).reshape(kinds, width)
        yield rows(b.column("word_key").to_numpy(), best, value)
    if grid.any():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([0.0]),
                pa.array([grid.ravel().tolist()], pa.list_(pa.int64()))
            ],
            names=["word_key", "class", "value", "counts"],
        )


def _bigrams(width: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (pos, n) of the bigrams of seed words a, whose number is `seed` + 1, with the text end last."""
    for b in batches:
        x, ends = _values(b.column("x"), "<u2")
        x, n = x.astype(np.int64), _values(b.column("n"), "<u4")[0].astype(np.int64)
        a = np.repeat(b.column("a").to_numpy(), np.diff(ends)).astype(np.int64)
        after, begins = (x >= width) & (x < width + seed) | (x == 2 * width - 1), x == width - 1
        other = np.where(x == 2 * width - 1, seed, x - width)
        pos = np.r_[a[after] * (seed + 1) + other[after], seed * (seed + 1) + a[begins]]
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(np.r_[n[after], n[begins]])], names=["pos", "n"])


def _dictionary(vocab: DataFrame, size: int):
    """A condition that holds for about the `size` most frequent words, at least most of them and at most a few more.

    Counts are binned, the bins are counted, and of the bin that does not fit whole a part is drawn by hash; so
    no task sorts or holds more than its own words.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    short = F.octet_length("word") <= LONGEST
    left, last, drawn = size, None, 0.0
    for r in sorted(vocab.where(short).groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if r["count"] > left:
            last, drawn = r.level, left / r["count"]
            break
        left -= r["count"]
    if last is None:
        return short
    part = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 20)) < int(drawn * (1 << 20))
    return short & ((level > last) | ((level == last) & part))


def _cells(width: int, batches: Iterator[pa.RecordBatch]):
    """(words, starts, class before or -1, cells, counts) of rows that carry a word's class as the count, plus one, of a
    cell after the last."""
    for b in batches:
        x, ends = _values(b.column("x"), "<u2")
        n, size = _values(b.column("n"), "<u4")[0].astype(np.int64), np.diff(ends)
        owner, mark = np.repeat(np.arange(len(size)), size), x == 2 * width
        before = np.full(len(size), -1)
        before[owner[mark]] = n[mark] - 1
        starts = np.searchsorted(owner[~mark], np.arange(len(size)))
        yield b.column("word_key").to_numpy(), starts, before, x[~mark], n[~mark]


def _grids(kinds: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by (class, neighbour class), as (pos, n), under the classes that words come with."""
    grid = np.zeros(kinds * 2 * width, np.int64)
    for _, starts, before, x, n in _cells(width, batches):
        own = np.repeat(before, np.diff(np.r_[starts, len(x)]))
        grid += np.bincount((own * 2 * width + x)[own >= 0], weights=n[own >= 0], minlength=len(grid)).astype(np.int64)
    at = np.flatnonzero(grid)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grid[at])], names=["pos", "n"])


def _decided(log_p: np.ndarray, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, starts, _, x, n in _cells(width, batches):
        best = choose(starts, x, n, log_p)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best)], names=["word_key", "class"])


def _over_all_neighbours(train: DataFrame, vocab: DataFrame, found: DataFrame, kinds: int, head: int) -> DataFrame:
    """(word_key, class) of every word, decided by the classes of all its neighbours; a written table.

    found(word_key, class) starts; words without a class there count as neighbours of a kind of their own. Neighbours in
    the dictionary find their class in the task, all others by a join.
    """
    sc, width = vocab.sparkSession.sparkContext, kinds + 2
    none = F.coalesce("class", F.lit(kinds)).alias("class")
    named = vocab.where(_dictionary(vocab, head)).select("word", _key_of("word").alias("word_key"))
    top = named.join(found, "word_key", "left").select("word", none).toArrow()
    share = sc.broadcast(_named([w.encode() for w in top.column("word").to_pylist()], top.column("class").to_numpy()))
    shape = _LISTS + ", side int, other long, m long"
    seen = written(train.mapInArrow(partial(_neighbours, share, width, True), shape), "seen")
    rest = seen.where("other is not null").join(found.withColumnRenamed("word_key", "other"), "other", "left").select(
        (F.shiftleft("word_key", _BITS) + F.col("side") + F.coalesce("class", F.lit(kinds))).alias("key"),
        F.col("m").alias("n"),
    )
    before = found.select(
        (F.shiftleft("word_key", _BITS) + 2 * width).alias("key"), (F.col("class") + 1).cast("long").alias("n")
    )
    cells = seen.where("other is null").select("word_key", "x", "n").union(rest.union(before).mapInArrow(_folded, _LISTS))
    dealt = cells.repartition(F.col("word_key")).sortWithinPartitions("word_key")
    table = written(dealt.mapInArrow(_packed, _LISTS), "neighbours")
    grid = np.zeros(kinds * 2 * width)
    sums = table.mapInArrow(partial(_grids, kinds, width), "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        grid[r.pos] = r.n
    log_p = likelihoods(grid.reshape(kinds, -1))
    now = written(table.mapInArrow(partial(_decided, log_p, width), "word_key long, class int"), "classes")
    share.destroy()
    discard(seen, table, found)
    return now


def _clustered(train: DataFrame, vocab: DataFrame, core: int, seed: int, kinds: int, head: int = HEAD) -> DataFrame:
    """(word_key, class) of every word; a written table."""
    sc = vocab.sparkSession.sparkContext
    rows = vocab.where(_dictionary(vocab, core)).select("word", "n").collect()
    words = [r.word.encode() for r in sorted(rows, key=lambda r: (-r.n, r.word))]
    width, seed = len(words) + 1, min(seed, len(words))
    assert 2 * width < 1 << _BITS
    rows = vocab.where(_dictionary(vocab, max(core, head))).select("word").toArrow()  # all core words are among them
    every, number = [w.encode() for w in rows.column("word").to_pylist()], {w: k for k, w in enumerate(words)}
    number = sc.broadcast(_named(every, [number.get(w, -1) for w in every]))
    seen = train.mapInArrow(partial(_neighbours, number, width, False), _LISTS)  # summed in each task, then by readers
    dealt = seen.repartition(F.col("word_key")).sortWithinPartitions("word_key")
    table = written(dealt.mapInArrow(_packed, _LISTS), "neighbours")

    # bigrams of the seed words and the text end start the classes
    at = vocab.sparkSession.createDataFrame(
        [(word_key(w), k) for k, w in enumerate(words[:seed])], "word_key long, a int"
    )
    own = table.join(F.broadcast(at), "word_key").select("a", "x", "n")
    own = own.mapInArrow(partial(_bigrams, width, seed), "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n"))
    own = own.toArrow()
    pairs = np.zeros((seed + 1) ** 2)
    pairs[own.column("pos").to_numpy()] = own.column("n").to_numpy()
    pairs = pairs.reshape(seed + 1, seed + 1)
    kinds = min(kinds, max(1, seed))
    start = exchange(pairs, kinds, FIRST)

    # numbers of neighbour classes: kinds for a core word without one, kinds + 1 for the end; left, then right
    none, end = kinds, kinds + 1
    class_of = np.full(width, none)
    class_of[:seed], class_of[-1] = start[:seed], end
    grid = np.zeros((kinds, 2 * (end + 1)))
    beside = np.where(start == kinds, end, start)[None]
    for side, counts in enumerate((pairs.T, pairs)):
        np.add.at(grid, (start[:seed, None], side * (end + 1) + beside), counts[:seed])
    place, before, found = {word_key(w): k for k, w in enumerate(words)}, None, None
    in_core = vocab.sparkSession.createDataFrame([(k,) for k in place], "word_key long")
    while True:
        both = np.r_[class_of, class_of + end + 1]
        shape = "word_key long, class int, value double, counts array<long>"
        out = written(table.mapInArrow(partial(_assign, likelihoods(grid), both), shape), "classes")
        value = out.agg(F.sum("value")).first()[0] or 0.0
        cells = out.where("word_key is null").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n"))
        grid = np.zeros(kinds * 2 * (end + 1))
        for r in cells.collect():
            grid[r.pos] = r.n
        grid = grid.reshape(kinds, -1)
        for r in out.join(F.broadcast(in_core), "word_key").select("word_key", "class").collect():
            class_of[place[r.word_key]] = r["class"]
        if found is not None:
            discard(found)
        found = out
        if before is not None and value - before <= SETTLED * abs(before):
            break
        before = value
    discard(table)
    number.unpersist()
    start = written(found.where("word_key is not null").select("word_key", "class"), "core_classes")
    discard(found)
    return _over_all_neighbours(train, vocab, start, kinds, head)


def _classes(dictionary, model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's classes as two bytes a token, what its words of the dictionary add to the scores, and the others."""
    number, class_of, log_base, log_word = (dictionary.value[k] for k in ("number", "class", "log_base", "log_word"))
    class_of = class_of if len(class_of) else np.zeros(1, np.int64)
    for b in sliced(batches, 500):
        split = [tokens(t.as_py()) for t in b.column("text").cast(pa.binary())]
        flat = list(chain.from_iterable(split))
        size = np.fromiter(map(len, split), np.int64, len(split))
        starts, text = np.r_[0, np.cumsum(size)], np.repeat(np.arange(len(split)), size)
        code = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
        other, named = np.flatnonzero(code < 0), np.flatnonzero(code >= 0)
        known = code[named]
        kinds = np.full(len(flat) + len(split), model["end"], "<i2")
        kinds[np.arange(len(flat)) + text] = np.where(code >= 0, class_of[code], model["unknown"])
        seen = np.bincount(text[named], minlength=len(split))
        base, own = (
            np.bincount(text[named], weights=x[known], minlength=len(split)).astype(float) for x in (log_base, log_word)
        )
        place = pa.array((other - starts[text[other]]).astype(np.int32))
        odd = pa.array([flat[k] for k in other.tolist()], pa.binary()).view(pa.string())
        ends = np.r_[0, np.cumsum(size - seen)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("held_out"), _binaries(kinds, starts + np.arange(len(starts))),
                pa.array(size + 1), pa.array(seen + model["end_known"]), pa.array(base + model["end_base"]), pa.array(own),
                pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([place, odd], names=["at", "w"])),
            ],
            names=["doc_id", "held_out", "kinds", "n_tokens", "n_known", "base_score", "emitted", "odd"],
        )


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the classes of joined words into their texts' classes."""
    for b in batches:
        kinds, starts = _values(b.column("kinds"), "<i2")
        kinds, found = kinds.copy(), b.column("found")
        new = found.flatten()
        text = np.repeat(np.arange(b.num_rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        kinds[starts[text] + new.field("at").to_numpy()] = new.field("class").to_numpy()
        names = [c for c in b.schema.names if c not in ("kinds", "found")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), _binaries(kinds, starts)], names=[*names, "kinds"]
        )


def _moves(size: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of class pairs by first * size + second; texts begin after an end."""
    counts = np.zeros(size * size, np.int64)
    for b in sliced(batches, 500):
        flat = _values(b.column("kinds"), "<i2")[0].astype(np.int64)
        counts += np.bincount(np.r_[end, flat[:-1]][: len(flat)] * size + flat, minlength=size * size)
    key = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts[key])], names=["key", "n"])


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    log_move, end = model.value
    for b in sliced(batches, 500):
        flat, starts = _values(b.column("kinds"), "<i2")
        moved = np.add.reduceat(log_move[np.r_[end, flat[:-1]], flat], starts[:-1])
        names = [c for c in b.schema.names if c != "kinds"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), pa.array(moved)], names=[*names, "moved"]
        )


def held_out():
    """Rows that the model does not learn from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(True))


def transitions(moves: np.ndarray, once: np.ndarray, in_class: np.ndarray) -> np.ndarray:
    """log10 probabilities of the next class (then the end, then the unknown word) after each class, the end, and
    the unknown word, from counts of class pairs with the end last."""
    share = (moves.sum(axis=0) + 0.5) / (moves.sum() + 0.5 * len(moves))
    p = (moves + STRENGTH * share) / (moves.sum(axis=1, keepdims=True) + STRENGTH)
    p = np.vstack([p, share])
    unknown = p[:, :-1] @ (once / (in_class + once))
    return np.log10(np.column_stack([p, unknown]))


def class_model_scores(
    docs: DataFrame, classes: int | None = None, core: int = CORE, seed: int = SEED, head: int = HEAD,
    clusters: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per document.

    score is the model's log10 probability of the text with its end, base_score that of the smoothed word
    frequencies. Null, empty and blank texts are one end token; very long texts are scored whole. Repeated rows all
    count; rows with a null doc_id are held out. Words of equal counts are told apart by their bytes, equal gains
    go to the first class. Without training documents the counts are zero and both scores rest on smoothing; an
    empty table gives an empty result. Other columns are ignored. `clusters` may give (word_key, class) itself.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    train = docs.where("not held_out").select("text")
    n_docs = train.count()
    vocab = train.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = written(vocab, "words")
    n_words, n_types = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, types = n_words + n_docs, n_types + (n_docs > 0)
    kinds = classes or n_classes(n_types)
    found = clusters(vocab) if clusters else _clustered(train, vocab, core, seed, kinds, head)
    # a class of their own for words that `clusters` leaves out
    lexicon = vocab.withColumn("word_key", _key_of("word")).join(found, "word_key", "left")
    lexicon = written(lexicon.select("word", "n", F.coalesce("class", F.lit(kinds)).alias("class")), "lexicon")
    in_class, once = np.zeros(kinds + 1), np.full(kinds + 1, 0.5)
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect():
        in_class[r["class"]] = r.n
        once[r["class"]] += r.once
    end, unknown, below = kinds + 1, kinds + 2, total + 0.5 * (types + 1)
    top = lexicon.where(_dictionary(lexicon, head)).toArrow()
    count, own = (top.column(c).to_numpy().astype(np.int64) for c in ("n", "class"))
    words = [w.encode() for w in top.column("word").to_pylist()]
    dictionary = sc.broadcast({
        "number": {w: k for k, w in enumerate(words)}, "class": own, "log_base": np.log10((count + 0.5) / below),
        "log_word": np.log10(count / (in_class + once)[own]),
    })
    model = {
        "end": end, "unknown": unknown, "end_known": int(n_docs > 0),
        "end_base": float(np.log10((n_docs + 0.5) / below))
    }
    shape = (
        f"doc_id {kind}, held_out boolean, kinds binary, n_tokens long, n_known long, base_score double, "
        "emitted double, odd array<struct<at:int,w:string>>"
    )
    coded = docs.mapInArrow(partial(_classes, dictionary, model), shape)
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "coded")

    n = F.coalesce(F.col("n"), F.lit(0))
    totals = F.element_at(F.array(*[F.lit(float(x)) for x in in_class + once]), F.col("class") + 1)
    odd = coded.select("row", F.inline("odd")).join(lexicon, F.col("w") == F.col("word"), "left").groupBy("row").agg(
        F.collect_list(F.when(n > 0, F.struct("at", "class"))).alias("found"), F.count_if(n > 0).alias("more_known"),
        F.sum(F.log10((n + 0.5) / below)).alias("more_base"),
        F.sum(F.when(n > 0, F.log10(n / totals))).alias("more_own"),
    )
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    whole = coded.join(odd, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), plus("base_score", "more_base"),
        plus("emitted", "more_own"), "kinds", "found",
    )
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, kinds binary"
    filled = written(whole.mapInArrow(_filled, shape), "filled")
    discard(coded, vocab)
    size = kinds + 3
    counted = filled.where("not held_out").select("kinds").mapInArrow(partial(_moves, size, end), "key long, n long")
    got = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros((size, size))
    key = got.column("key").to_numpy()
    moves[key // size, key % size] = got.column("n").to_numpy()
    log_move = transitions(moves[:unknown, :unknown], once, in_class)
    moved = filled.mapInArrow(
        partial(_score, sc.broadcast((log_move, end))), shape.replace("kinds binary", "moved double")
    )
    score = (F.col("moved") + F.col("emitted")).alias("score")
    out = moved.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score",
        score
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
