"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingles verify them.

Words are lower-cased ASCII letters, digits and characters above ASCII; shingles are SHINGLE words; a
template of fewer is looked up word by word. A template with m shingles belongs to the size class of the largest power of two
c <= m; windows of that class span 2.5 c shingles and start every c / 2, so each occurrence lies whole inside
a window whose Jaccard similarity with it is at least 0.29 even at a containment of 0.8. With BANDS bands of
one row each, such a window is missed with a probability below 0.71 ** BANDS, about 2 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .decontaminate import words_of
from .templates import TEMPLATES

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 32
#: The broadcast templates hold at most so many words in all.
MAX_TEMPLATE_WORDS = 2_000_000
_SEEDS = np.random.default_rng(5).integers(
    1, 1 << 32, size=(BANDS, 2), dtype=np.uint64
).astype(np.uint32) | np.uint32(1)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of all shingles in order; one for a text of fewer words, none without words."""
    if not words:
        return np.empty(0, np.uint32)
    h = word_hashes(words)
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint32)
    for k in range(min(size, len(words))):
        out = (out ^ h[k : k + n]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of every word from its length and bytes, the same in every process."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
    ends = np.cumsum(size)
    place = (np.arange(len(flat)) - np.repeat(ends - size, size)).astype(np.uint32)
    mixed = (flat + np.uint32(1)) * ((place * np.uint32(0x85EBCA6B) ^ np.uint32(0xC2B2AE35)) | np.uint32(1))
    mixed ^= mixed >> np.uint32(13)
    mixed *= np.uint32(0x27D4EB2F)
    return np.add.reduceat(mixed, ends - size, dtype=np.uint32) + size.astype(np.uint32)


class Templates:
    """Signatures of the templates by size class, with their shingles for the exact check."""

    def __init__(self, rows: list[tuple[str, bytes]], size: int = SHINGLE):
        self.size, self.names, self.shingles, classes = size, [], [], {}
        self.short: list[list[bytes]] = []  # words of templates below a shingle, which are looked up as they are
        for name, text in rows:
            words = words_of(text)
            if not words:
                continue
            self.names.append(name)
            self.short.append(words if len(words) < size else [])
            n = max(1, len(words) - size + 1)
            self.shingles.append({tuple(words[k : k + size]) for k in range(n)})
            if len(words) < size:
                continue
            h = shingle_hashes(words, size)
            sig = np.array([((h ^ a) * b).min() for a, b in _SEEDS], np.uint32)
            step = 1 << (len(self.shingles[-1]).bit_length() - 1)
            classes.setdefault(step, []).append((len(self.names) - 1, sig))
        # by class: for every band the sorted minima and the templates that have them
        self.classes = {}
        for step, members in classes.items():
            sigs, who = np.array([s for _, s in members]), np.array([k for k, _ in members])
            order = np.argsort(sigs, axis=0, kind="stable")
            self.classes[step] = (np.take_along_axis(sigs, order, 0), who[order])

    def scan(self, texts: list[list[bytes]], containment: float) -> list[tuple[int, str, float, int, int]]:
        """(text, template, containment, first word, word after) of every verified place, in order.

        Texts are laid end to end; shingles across their ends never match.
        """
        size, n_words = self.size, np.array([len(w) for w in texts], np.int64)
        words = [w for t in texts for w in t]
        if not words or not self.names:
            return []
        text_of, first = np.repeat(np.arange(len(texts)), n_words), np.cumsum(n_words) - n_words
        h = shingle_hashes([*words, *[b"\0"] * (size - 1)], size)
        inside = np.arange(len(h)) - first[text_of] + size <= n_words[text_of]
        marked = self._candidates(h, ~inside)
        found: dict[tuple[int, int], list] = {}
        for step, pairs in marked.items():
            stride, span = self._window(step)
            for w, t in pairs:
                here: dict[int, dict] = {}
                for k in range(w * stride, min(len(h), (w + span) * stride)):
                    if inside[k] and (x := tuple(words[k : k + size])) in self.shingles[t]:
                        here.setdefault(int(text_of[k]), {}).setdefault(x, []).append(k)
                for text, places in here.items():
                    if (share := len(places) / len(self.shingles[t])) >= containment:
                        ks = [k for x in places.values() for k in x]
                        found.setdefault((text, t), []).append((min(ks), max(ks) + size, share))
        codes = word_hashes(words)
        for t, known in enumerate(self.short):
            m = len(known)
            if not m or len(codes) < m:
                continue
            own = word_hashes(known)
            same = text_of[: len(codes) - m + 1] == text_of[m - 1 :]
            for k in range(m):
                same &= codes[k : len(codes) - m + 1 + k] == own[k]
            for k in np.flatnonzero(same).tolist():
                if words[k : k + m] == known:
                    found.setdefault((int(text_of[k]), t), []).append((k, k + m, 1.0))
        out = []
        for (text, t), spans in found.items():
            spans.sort()
            a, z, share = spans[0]
            for x, y, s in [*spans[1:], (1 << 62, 0, 0.0)]:
                if x < z:
                    z, share = max(z, y), max(share, s)
                else:
                    out.append((text, self.names[t], share, int(a - first[text]), int(z - first[text])))
                    a, z, share = x, y, s
        return sorted(out, key=lambda x: (x[0], x[3], x[1]))

    @staticmethod
    def _window(step: int) -> tuple[int, int]:
        """(shingles between window starts, strides in a window)."""
        stride = max(1, step // 2)
        return stride, -(-(2 * step + stride) // stride)

    def _candidates(self, h: np.ndarray, bad: np.ndarray) -> dict[int, set]:
        """By class: (window, template) pairs whose minima agree in a band."""
        none, marked = np.uint32(0xFFFFFFFF), {step: set() for step in self.classes}
        bad = np.flatnonzero(bad)
        for band, (a, b) in enumerate(_SEEDS):
            p = (h ^ a) * b
            p[bad] = none
            for step, (sigs, who) in self.classes.items():
                stride, span = self._window(step)
                low = p
                if stride > 1:
                    low = np.minimum.reduce(
                        np.pad(p, (0, -len(p) % stride), constant_values=none).reshape(-1, stride), axis=1
                    )
                low = np.pad(low, (0, span - 1), constant_values=none)
                m = len(low) - span + 1
                best = low[:m].copy()
                for k in range(1, span):
                    np.minimum(best, low[k : k + m], out=best)
                for x in range(len(sigs)):
                    marked[step].update((w, int(who[x, band])) for w in np.flatnonzero(best == sigs[x, band]).tolist())
        return marked


def _groups(texts: list[bytes | None], most: int = 1 << 16) -> Iterator[tuple[int, list[list[bytes]]]]:
    start, held, n = 0, [], 0
    for k, t in enumerate(texts):
        held.append(words_of(t))
        n += len(held[-1])
        if n >= most:
            yield start, held
            start, held, n = k + 1, [], 0
    if held:
        yield start, held


def _scan(templates, containment: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2000):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        got = [
            (start + x[0], *x[1:]) for start,
            words in _groups(texts) for x in templates.value.scan(words, containment)
        ]
        cols = list(zip(*got)) if got else [[], [], [], [], []]
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        found = [pa.array(c, k) for c, k in zip(cols[1:], kinds)]
        ids = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [ids, *found], names=["doc_id", "template", "containment", "first_word", "end_word"]
        )


def license_scan(
    docs: DataFrame, notices: list[tuple[str, str]] | DataFrame | None = None, containment: float = CONTAINMENT
) -> DataFrame:
    """(doc_id, template, containment, first_word, end_word) of every place where a template occurs.

    A window matches if it holds at least `containment` of the template's distinct word shingles; overlapping
    windows are one place. Where several templates match (a text and its first sentence, say), each is reported.
    Null, empty and wordless texts match nothing, very long texts are scanned whole, repeated rows match alike, and
    rows with a null doc_id keep it. Templates are a small table (template, text); one above MAX_TEMPLATE_WORDS is
    refused before it is collected. Without templates, or without documents, the result is empty; other columns
    are ignored.
    """
    spark = docs.sparkSession
    if isinstance(notices, DataFrame):
        size = notices.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        if size > 2 * MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of {size} bytes are above the bound; scan them in parts")
        notices = [(r[0], r[1] or "") for r in notices.select("template", "text").collect()]
    known = Templates([(k, t.encode()) for k, t in (TEMPLATES if notices is None else notices)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, template string, containment double, first_word long, end_word long"
    scan = partial(_scan, spark.sparkContext.broadcast(known), containment)
    return docs.select("doc_id", "text").mapInArrow(scan, shape)
