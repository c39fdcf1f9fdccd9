"""Substring deduplication by content-defined chunking with a gear rolling hash.

Every word has the gear hash of the 16 bytes before it. A text is cut before a word whose hash is the
least among the SIDE words on either side, so cuts move with the content, an insertion disturbs only the chunks
around it, and chunks have SIDE + 1 words or more. Chunks alone are too short to tell a passage from chance, so
a digest covers a chunk and those after it up to MIN_WORDS words: what is compared always stood in one piece.
The occurrence with the smallest (doc_id, text hash, position) stays; chunks under later ones are cut out.
Since each of them has an earlier equal, every chunk that goes is left in some document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Words on either side that a cut's hash is least among, words in the longest chunk, bytes that a hash sees.
SIDE, LONGEST, SEEN = 3, 64, 16
#: A digest covers so many words at least.
MIN_WORDS = 20
#: Bytes of text that are laid out at once, and documents whose digests are compared before they are sent.
PIECE, SENT = 4 << 20, 4000
#: The position of the window that ends with its text.
TAIL = 2**31 - 1
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (
    np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(23)
)
_GEAR = (_GEAR >> np.uint64(33)).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + G[byte] at some places, modulo 2^16, so that it sees the last 16 bytes."""
    h = np.zeros(len(at), np.uint32)
    for k in range(SEEN):
        h += _GEAR[data[at - k]] << np.uint32(k)
    return h & np.uint32(0xFFFF)


class Layout:
    """Words, chunks and windows of some texts, laid end to end with blanks between them.

    Chunk k has the words word[k] to word[k + 1]; window k covers chunks k to last[k], and only those of `starts`
    are long enough. Where no window ends with the text, one that does and begins as late as it can is added.
    """

    def __init__(self, texts: list[bytes], min_words: int = MIN_WORDS):
        gap = b" " * SEEN
        self.buffer = gap + gap.join(texts) + gap
        data = np.frombuffer(self.buffer, np.uint8)
        blank = _BLANK[data]
        self.begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        size = np.array([len(t) for t in texts], np.int64)
        self.origin = SEEN + np.cumsum(size + SEEN) - size - SEEN
        first = np.searchsorted(self.begin, self.origin)
        bounds = np.r_[first, len(self.begin)]
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        h = gear(data, self.begin - 1).astype(np.int64)
        cut = np.ones(len(h), bool)
        for k in range(1, SIDE + 1):
            same = text[k:] == text[:-k]
            cut[k:] &= ~same | (h[k:] < h[:-k])
            cut[:-k] &= ~same | (h[:-k] <= h[k:])
        cut[first[np.diff(bounds) > 0]] = True
        at = np.flatnonzero(cut)
        long = np.diff(np.r_[at, len(h)]) > LONGEST
        if long.any():
            stop = np.r_[at[1:], len(h)]
            more = [np.arange(a, z, LONGEST) for a, z in zip(at[long].tolist(), stop[long].tolist())]
            at = np.unique(np.concatenate([at, *more]))
        self.word = np.r_[at, len(h)]
        self.text = text[at]
        n = np.bincount(self.text, minlength=len(texts))
        self.chunks = np.r_[0, np.cumsum(n)]
        stop = self.chunks[self.text + 1]
        self.last = np.searchsorted(self.word, self.word[:-1] + min_words)
        self.starts = np.flatnonzero(self.last <= stop)
        # the suffix window of each text: the last chunk from which enough words are left
        tail = np.searchsorted(self.word, self.word[self.chunks[1:]] - min_words, "right") - 1
        other = (n > 0) & (tail >= self.chunks[:-1])
        other[other] = self.last[tail[other]] != self.chunks[1:][other]
        self.tail = np.where(other, tail, -1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, first byte, byte after) of every window; suffixes have the position TAIL."""
        ends = np.flatnonzero(self.tail >= 0)
        a = np.r_[self.starts, self.tail[ends]]
        z = np.r_[self.last[self.starts], self.chunks[ends + 1]]
        place = np.r_[self.starts - self.chunks[self.text[self.starts]], np.full(len(ends), TAIL)]
        return self.text[a], place, self.begin[self.word[a]], self.end[self.word[z] - 1]

    def covered(self, text: int, places: np.ndarray) -> np.ndarray:
        """Which chunks of a text lie under its windows at these positions."""
        first, stop = self.chunks[text], self.chunks[text + 1]
        whole = first + places[places != TAIL]
        a, z = whole, self.last[whole]
        if (places == TAIL).any():
            a, z = np.r_[a, self.tail[text]], np.r_[z, stop]
        steps = np.zeros(stop - first + 1, np.int64)
        np.add.at(steps, a - first, 1)
        np.add.at(steps, z - first, -1)
        return np.cumsum(steps[:-1]) > 0

    def without(self, text: int, gone: np.ndarray) -> tuple[bytes, int, int]:
        """(the text without these chunks, runs that went, words that went)."""
        first = self.chunks[text]
        edge = first + np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        own, stop = self.origin[text], self.origin[text + 1] - SEEN if text + 1 < len(
            self.origin
        ) else len(self.buffer) - SEEN
        keep, at, words = [], own, 0
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            keep.append(self.buffer[at : self.begin[self.word[a]]])
            at = self.begin[self.word[z]] if z < self.chunks[text + 1] else stop
            words += int(self.word[z] - self.word[a])
        return b"".join([*keep, self.buffer[at:stop]]).strip(), len(edge) // 2, words


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of about PIECE bytes."""
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= PIECE:
            yield start, texts[start : k + 1]
            start, n = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal values, nulls included."""
    same = pa.compute.fill_null(pa.compute.equal(a, b), False).to_numpy(zero_copy_only=False).astype(bool)
    return same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def _ranked(ids: pa.Array) -> np.ndarray:
    """Dense ranks in order of the values, nulls first."""
    order = pa.compute.sort_indices(ids, null_placement="at_start")
    new = ~_equal(ids.take(order[1:]), ids.take(order[:-1]))
    rank = np.empty(len(ids), np.int64)
    rank[order.to_numpy()] = np.cumsum(np.r_[0, new.astype(np.int64)])
    return rank


_FIELDS = ["d1", "d2", "doc_id", "text_hash", "place", "sure"]


def _digests(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, doc_id, text_hash, place, sure): 128 bits of every window.

    Inside a batch only the first occurrence of a digest is sent to be compared; later ones are sure to be
    repeats and are dealt out by their own place, so that a passage which a third of all documents share
    arrives once per batch.
    """
    digest_of = xxhash.xxh3_128_digest
    for b in sliced(batches, SENT):
        found, texts = [], [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        for start, part in _pieces(texts):
            layout = Layout(part, min_words)
            text, place, a, z = layout.windows()
            data = memoryview(layout.buffer)
            digest = b"".join([digest_of(data[x:y]) for x, y in zip(a.tolist(), z.tolist())])
            found.append((np.frombuffer(digest, np.int64).reshape(-1, 2), text + start, place))
        if not sum(len(x[1]) for x in found):
            continue
        digest, row, place = (np.concatenate([x[k] for x in found]) for k in range(3))
        ids, keys = b.column("doc_id"), b.column("text_hash").to_numpy(zero_copy_only=False).astype(np.int64)
        key, rank = keys[row], _ranked(ids)[row]
        order = np.lexsort((place, key, rank, digest[:, 1], digest[:, 0]))
        d, r, p, h = digest[order], rank[order], place[order], key[order]
        head = np.r_[True, (d[1:] != d[:-1]).any(axis=1)]
        first = np.maximum.accumulate(np.where(head, np.arange(len(d)), 0))
        later = (r != r[first]) | (p != p[first]) | (h != h[first])
        send = np.sort(order[head | later])  # repeated rows of the first occurrence say nothing new
        sure = np.zeros(len(order), bool)
        sure[order[later]] = True
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(digest[send, 0]), pa.array(digest[send, 1]), ids.take(pa.array(row[send])),
                pa.array(key[send]), pa.array(place[send].astype(np.int32)), pa.array(sure[send]),
            ],
            names=_FIELDS,
        )


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of _FIELDS: sure repeats, and all but each digest's first place of the others."""
    out = ["doc_id", "text_hash", "place"]
    last = None
    for b in batches:
        sure = b.column("sure")
        yield b.filter(sure).select(out)
        rest = b.filter(pa.compute.invert(sure))
        if not rest.num_rows:
            continue
        d1, d2, key, place = (rest.column(c).to_numpy() for c in ("d1", "d2", "text_hash", "place"))
        ids = rest.column("doc_id")
        head = np.r_[last is None or last[0] != (d1[0], d2[0]), (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]
        at = np.maximum.accumulate(np.where(head, np.arange(len(d1)), -1))
        top = np.maximum(at, 0)
        own = _equal(ids, ids.take(pa.array(top))) & (place == place[top]) & (key == key[top])
        before = at < 0  # rows of the digest that the batch before ended with
        if before.any():
            alike = np.array([x == last[1] for x in ids.filter(pa.array(before)).to_pylist()], bool)
            own[before] = alike & (key[before] == last[2]) & (place[before] == last[3])
        yield rest.filter(pa.array(~own)).select(out)
        if at[-1] >= 0:
            k = int(at[-1])
            last = ((d1[k], d2[k]), ids[k].as_py(), key[k], place[k])


def _cut(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 1000):
        texts, places = b.column("text").cast(pa.binary()).to_pylist(), b.column("__repeats").to_pylist()
        runs, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        rows = [k for k, p in enumerate(places) if p]
        for start, part in _pieces([texts[k] for k in rows]):
            layout = Layout(part, min_words)
            for k, row in enumerate(rows[start : start + len(part)]):
                texts[row], runs[row], words[row] = layout.without(k, layout.covered(k, np.array(places[row])))
        names = [c for c in b.schema.names if c not in ("text", "__repeats")]
        new = pa.array(texts, pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), new, pa.array(runs), pa.array(words)],
            names=[*names, "text", "n_removed_runs", "n_removed_words"],
        )


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with repeated passages cut from text, then n_removed_runs and n_removed_words.

    Of equal passages that with the smallest (doc_id, text hash, position) stays, a null doc_id before all
    others; the later ones, of at least `min_words` words, are removed and the text's ends trimmed. Words stand
    between ASCII blanks, so a text without blanks is one word and stays. Null and empty texts stay as they are;
    a very long text is cut like any other, its own later repeats too. Rows that repeat both doc_id and text
    count as one document and keep the same text. Other columns are carried along, those named n_removed_runs or
    n_removed_words are replaced, and __hash and __repeats left out. An empty table gives an empty result.
    """
    docs = docs.drop("n_removed_runs", "n_removed_words", "__hash", "__repeats")
    mark = F.xxhash64("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"d1 long, d2 long, doc_id {kind}, text_hash long, place int, sure boolean"
    rows = docs.where("text <> ''").select("doc_id", "text", mark.alias("text_hash"))
    digests = rows.mapInArrow(partial(_digests, min_words), shape)
    dealt = digests.repartition(F.when(F.col("sure"), F.xxhash64("text_hash", "place")).otherwise(F.col("d1")))
    repeats = dealt.sortWithinPartitions(*_FIELDS[:5]).mapInArrow(_repeats, f"doc_id {kind}, text_hash long, place int")
    found = repeats.groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("repeats"))
    left, right = docs.withColumn("__hash", mark).alias("l"), found.alias("r")
    same = (F.col("l.__hash") == F.col("r.text_hash")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    names = [f.name for f in docs.schema if f.name != "text"]
    ready = left.join(right, same, "left")
    ready = ready.select(*(F.col(f"l.`{c}`") for c in names), F.col("l.text"), F.col("r.repeats").alias("__repeats"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shape += ", text string, n_removed_runs long, n_removed_words long"
    out = ready.mapInArrow(partial(_cut, min_words), shape)
    return out.select(*(f"`{c}`" for c in docs.columns), "n_removed_runs", "n_removed_words")
