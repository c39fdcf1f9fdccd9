"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's distinct unknown words lie in one flat array of symbols. A round looks up every neighbouring pair
by binary search over the sorted pair keys, takes each word's lowest rank, and merges all of its occurrences
from left to right; words without a mergeable pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sliced

#: Fixed: the pre-tokenizer's pattern, with \s spelt as the White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes as they are, the rest from U+0100 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class WordBpe:
    """A vocabulary with word ends: encodes words in batches and keeps what it has encoded, up to a bound."""

    def __init__(self, path: str, keep: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], np.int64)
        self.token = [""] * max(size, max(self.special.values(), default=0) + 1)
        for t, k in [*vocab.items(), *self.special.items()]:
            self.token[k] = t
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.keep, self.known = keep, {t: (1, str(k), t) for t, k in self.special.items()}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens' strings stand for themselves."""
        if self.cut and "<|" in text:
            parts = self.cut.split(text)
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # a capital sigma becomes the plain small one, as letters are lowered one by one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids per word) of words that are no special tokens."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            live = least < _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
            hit = rank == least
            if not hit.any():
                continue
            # overlapping occurrences (a a a): every other one of a run, from the left
            at = np.arange(len(hit))
            head = hit & ~np.r_[False, hit[:-1]]
            start = np.maximum.accumulate(np.where(head, at, 0))
            hit &= (at - start) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(len(raw), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def learn(self, words: set[str]) -> None:
        """Encode words not met before; forget all others first when too many are kept."""
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > self.keep:
            self.known = {t: (1, str(k), t) for t, k in self.special.items()}
            new = list(words - self.known.keys())
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            flat, n = self.ids(part)
            flat, at, token = flat.tolist(), 0, self.token
            for w, k in zip(part, n.tolist()):
                own = flat[at : at + k]
                at += k
                self.known[w] = (k, " ".join(map(str, own)), " ".join([token[x] for x in own]))

    def decode(self, ids: list[int]) -> str:
        """The tokens with blanks between them: the vocabulary names no decoder."""
        return " ".join([self.token[k] for k in ids if 0 <= k < len(self.token)])

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn(set(words))
        return [int(x) for w in words for x in self.known[w][1].split()]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encode(path: str, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    for b in sliced(batches, 1000):
        texts = [t or "" for t in b.column("text").to_pylist()]
        counts, left, right = [], [], []
        for a, z in _groups(texts):
            split = [bpe.words(t) for t in texts[a:z]]
            bpe.learn(set().union(*split))
            known = bpe.known
            for words in split:
                got = [known[w] for w in words]
                counts.append(sum([x[0] for x in got]))
                ids, text = " ".join([x[1] for x in got]), " ".join([x[2] for x in got])
                if digests:
                    left.append(hashlib.sha256(ids.encode()).hexdigest())
                    right.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    left.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.empty(0, np.int32))
                    right.append(text)
        kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
        names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        kept = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(left, kinds[0]),
                pa.array(right, kinds[1])
            ],
            names=[*kept, "n_tokens", *names]
        )


def bpe_encode(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids and decoded, or the SHA-256 of both, for every document.

    ids are the whole text's token ids without added tokens; strings of special tokens in the text become
    those tokens. A null or empty text has no ids and decodes to an empty text; a very long one is encoded whole,
    and an empty table gives an empty result. Rows are taken one by one, so repeated rows, null ids and other columns
    make no difference. The vocabulary is a file on every worker. Characters that Unicode has assigned since version 16 may be split in other places than by a
    library with other tables.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(
        partial(_encode, vocabulary, digests), f"doc_id {kind}, n_tokens long, {more}"
    )
