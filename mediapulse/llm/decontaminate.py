"""Benchmark decontamination: a set of hashed item windows against every document's token windows.

The set is broadcast and holds at most MAX_WORDS item words. A larger benchmark is scanned in slices, one set at a
time: a slice's hits are written before the next one is read, so neither the driver nor an executor ever holds
more than one set, and only documents with hits leave a row behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

WINDOW = 10
#: A broadcast set holds at most so many item words; larger benchmarks are scanned in several passes over the texts.
MAX_WORDS = 2_000_000
#: Fixed: bytes that are no ASCII letter or digit become blanks, A-Z become lower case.
_FOLD = bytes(
    (b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WindowSet:
    """Item windows by length: sorted hashes over word numbers, with the windows themselves for the check."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            codes = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            n = min(size, len(codes))
            for k in range(len(codes) - n + 1 if n else 0):
                owners = found.setdefault(n, {}).setdefault(tuple(codes[k : k + n]), set())
                owners.update([] if item is None else [item])
        self.by_length = {}
        for n, windows in found.items():
            grid = np.array(list(windows), np.int64).reshape(len(windows), n)
            owners = [sorted(x) for x in windows.values()]
            h = self.hashes(grid.T)
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], grid[order], [owners[k] for k in order])
        self.least = min(self.by_length, default=0)

    @staticmethod
    def hashes(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Spans (first word, word after) of the windows that occur, and the items that own them."""
        spans, owners = [], set()
        if not self.by_length or len(words) < self.least:
            return np.empty((0, 2), np.int64), owners
        get = self.number.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        outside = np.r_[0, np.cumsum(codes < 0)]
        for n, (hashes, grid, items) in self.by_length.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(outside[n:] == outside[:-n])
            if not len(at):
                continue
            columns = [codes[at + k] for k in range(n)]
            h = self.hashes(columns)
            k = np.searchsorted(hashes, h)
            k_end = np.searchsorted(hashes, h, "right")
            live = np.flatnonzero(k_end > k)
            for p in live.tolist():
                own = codes[at[p] : at[p] + n]
                for x in range(k[p], k_end[p]):
                    if np.array_equal(grid[x], own):
                        spans.append((at[p], at[p] + n))
                        owners.update(items[x])
        return np.array(sorted(spans), np.int64).reshape(-1, 2), owners


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; what stands between two hit words goes too."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8)
    inside = np.r_[False, folded != 32, False]
    edges = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep, last, k = [], 0, 0
    runs = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    for a, b in zip(runs[::2], runs[1::2]):
        keep.append(text[last : starts[a]])
        last = ends[b - 1]
    keep.append(text[last:])
    return b"".join(keep)


def _found(texts: list[bytes], hits: list[tuple[np.ndarray, list[str]]], clean: bool) -> dict[str, pa.Array]:
    """Output columns from each text's spans and items."""
    words = [len(words_of(t)) for t in texts]
    marks = [covered(spans, n) if len(spans) else None for (spans, _), n in zip(hits, words)]
    out = {
        "n_words": pa.array(words, pa.int64()),
        "n_hit": pa.array([0 if m is None else int(m.sum()) for m in marks], pa.int64()),
        "items": pa.array([items for _, items in hits], pa.list_(pa.string())),
    }
    if clean:
        out["text"] = pa.array(
            [(t if m is None else cut_spans(t, m)).decode("utf-8", "replace") for t, m in zip(texts, marks)],
            pa.string()
        )
    return out


def _batch(b: pa.RecordBatch, without: tuple[str, ...], new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {c: b.column(c) for c in b.schema.names if c not in without and c not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def _scan(windows, clean: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2000):
        texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        got = [windows.value.scan(words_of(t)) for t in texts]
        yield _batch(b, ("text",), _found(texts, [(spans, sorted(map(str, items))) for spans, items in got], clean))


def _hits(windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, spans, items) of the documents that hold windows of one set."""
    for b in sliced(batches, 2000):
        got = [windows.value.scan(words_of(t)) for t in b.column("text").cast(pa.binary()).to_pylist()]
        at = [k for k, (spans, _) in enumerate(got) if len(spans)]
        spans = pa.array([got[k][0].ravel().tolist() for k in at], pa.list_(pa.int64()))
        items = pa.array([sorted(map(str, got[k][1])) for k in at], pa.list_(pa.string()))
        ids = [b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*ids, spans, items], names=["doc_id", "text_hash", "spans", "items"])


def _close(clean: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        found = zip(b.column("spans").to_pylist(), b.column("items").to_pylist())
        hits = [(np.array(s or [], np.int64).reshape(-1, 2), sorted(set(i or []))) for s, i in found]
        yield _batch(b, ("text", "spans"), _found(texts, hits, clean))


def slices(benchmark: DataFrame, max_words: int = MAX_WORDS) -> list[DataFrame]:
    """The benchmark in parts of about `max_words` words, by hashed items; an item is never split.

    The bytes of all texts are summed before anything is collected.
    """
    n = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-n // (2 * max_words)))
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    if parts == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def window_set(rows: DataFrame, size: int = WINDOW) -> WindowSet:
    """The windows of one slice."""
    return WindowSet([(r.item_id, bytes(r.text or b"")) for r in rows.collect()], size)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, clean: bool = False, max_words: int = MAX_WORDS
) -> DataFrame:
    """The columns of docs but text, then n_words, n_hit, items; with `clean` also text without its hit words.

    A window is `size` consecutive item words; a shorter item is one window; null, empty and wordless texts
    have none. Every window that a document holds is verified word by word after its hash matches, and all
    words inside any occurrence are hit; items with a null id hit words but are not listed. Very long texts are
    scanned whole, rows with a null doc_id and repeated rows like others; an empty benchmark hits nothing, and an
    empty table of documents gives an empty result. Columns named n_words, n_hit or items are
    replaced, those named spans or text_hash left out.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans", "text_hash")
    share = docs.sparkSession.sparkContext.broadcast
    parts = slices(benchmark, max_words)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    last = ", ".join([*shape, "n_words long", "n_hit long", "items array<string>", *(["text string"] * clean)])
    if len(parts) == 1:
        return docs.mapInArrow(partial(_scan, share(window_set(parts[0], size)), clean), last)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed, found = docs.withColumn("text_hash", F.xxhash64("text")), None
    for rows in parts:
        windows = share(window_set(rows, size))
        hits = keyed.where("text is not null").select("doc_id", "text_hash", "text").mapInArrow(
            partial(_hits, windows), f"doc_id {kind}, text_hash long, spans array<long>, items array<string>"
        )
        hits = written(hits, "hits")
        found = hits if found is None else found.union(hits)
        windows.destroy()
    merged = found.groupBy("doc_id", "text_hash").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    k, m = keyed.alias("k"), merged.alias("m")
    same = (F.col("k.text_hash") == F.col("m.text_hash")) & F.col("k.doc_id").eqNullSafe(F.col("m.doc_id"))
    rows = k.join(m, same, "left").select(*(F.col(f"k.`{c}`") for c in docs.columns), "m.spans", "m.items")
    return rows.mapInArrow(partial(_close, clean), last)
