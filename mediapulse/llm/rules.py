"""Quality rules, line first: lines that break a rule go, then texts that lose too much.

All steps are Arrow and numpy passes over the lines and words of many texts at once; a text is never shortened, and a
batch holds at most BYTES of text, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sliced

#: Bytes of text that a worker splits at once.
BYTES = 4_000_000
#: Fixed: white space between words, and characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Fixed: patterns of the line rules, in the syntax that Arrow and DuckDB share.
BULLET = r"^[\x20\x09-\x0D]*[#*>-]+[\x20\x09-\x0D]"
SEPARATOR = r"[\x20\x09-\x0D][|»›•·→>]+([\x20\x09-\x0D]|$)"
SHOUT = r"[!?][!?]+"
CLOSED = r"[.!?…:;,\"')\]»”’。！？，、-][\x20\x09-\x0D]*$"
BOILERPLATE = (
    r"(?i)(accept (all )?cookies|cookie (policy|settings|preferences|consent)|(we|site) uses? cookies|privacy policy"
    r"|terms (of|and) (use|service|conditions)|all rights reserved|(enable|disabled|requires) javascript"
    r"|javascript is|lorem ipsum|subscribe to (our|the)|sign (up|in) (for|to|now)|log ?in to|click here|read more"
    r"|share (this|on) |follow us|powered by|skip to (main )?content|back to top|page [0-9]+ of [0-9]+|advertisement)"
)
#: A line of so many words or more needs no closing mark; boilerplate phrases mark lines up to so many words.
OPEN_WORDS, PHRASE_WORDS = 6, 25
#: A text may lose this share of its words, in per cent.
MOST_LOST = 30
RULES = ["navigation", "symbols", "shouting", "unclosed", "boilerplate", "repeated"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "n_lines", "n_kept_lines"]


def line_rules(lines: pa.Array) -> dict[str, np.ndarray]:
    """For each distinct line: its words, and which rules of its own form it breaks."""
    count = lambda pattern, x=lines: pc.count_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
    has = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    words = count(WORD).astype(np.int64)
    plain = pc.replace_substring_regex(lines, BULLET, "", max_replacements=1)
    separators, symbols, shouts = count(SEPARATOR), count(SYMBOL, plain), count(SHOUT)
    return {
        "words": words,
        "navigation": (separators >= 2) & (separators * 4 >= words),
        "symbols": (symbols >= 3) & (symbols * 2 >= words),
        "shouting": (shouts >= 2) & (shouts * 3 >= words),
        "unclosed": (words < OPEN_WORDS) & ~has(CLOSED),
        "boilerplate": (words <= PHRASE_WORDS) & has(BOILERPLATE),
    }


def repeat_words(words: pa.Array, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: words inside three-word windows that the text holds twice or more.

    Windows are numbered exactly, as pairs of a pair's number and a word's number.
    """
    if len(words) < 3:
        return np.zeros(n, np.int64)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.flatnonzero(text[2:] == text[:-2])
    pair = pd.factorize(code[at] * (code.max() + 1) + code[at + 1])[0]
    window = pd.factorize(pair * (code.max() + 1) + code[at + 2])[0]
    owned = pd.factorize(window * n + text[at])[0]
    twice = at[np.bincount(owned)[owned] > 1] if len(owned) else at
    hit = np.zeros(len(code), bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(text[hit], minlength=n)


def judged(texts: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array]:
    """Counts of each text, and the text of its kept lines."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    chars = pc.utf8_length(texts).to_numpy() - pc.count_substring_regex(texts, SPACE).to_numpy()
    split = pc.split_pattern_regex(texts, SPACE + "+")
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    real = pc.not_equal(words, "")
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    lines = pc.split_pattern(texts, "\n")
    flat, text = lines.flatten(), pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    rules = {k: v[code] for k, v in line_rules(coded.dictionary).items()}
    size = rules.pop("words")
    again = pd.Series(text * (len(coded.dictionary) + 1) + code).duplicated().to_numpy() & (size > 0)
    rules["repeated"] = again
    fails = np.logical_or.reduce([rules[r] for r in RULES]) & (size > 0)
    total = lambda x: np.bincount(text, x, n).astype(np.int64)
    out = {
        "n_words": np.bincount(owner, minlength=n), "word_chars": chars,
        "n_symbols": pc.count_substring_regex(texts, SYMBOL).to_numpy(), "n_dup_lines": total(again),
        "n_repeat_words": repeat_words(words, owner, n), "n_kept_words": total(size * ~fails),
        "n_lines": total(size > 0), "n_kept_lines": total((size > 0) & ~fails),
    }
    seen = np.zeros(len(text), bool)
    for r in RULES:  # a line counts under the first rule that it breaks
        first = rules[r] & (size > 0) & ~seen
        out[f"lines_{r}"] = total(first)
        seen |= first
    kept = np.bincount(text[~fails], minlength=n)
    offsets = pa.array(np.r_[0, np.cumsum(kept)], pa.int64())
    clean = pa.LargeListArray.from_arrays(offsets, flat.filter(pa.array(~fails)))
    return out, pc.binary_join(clean, pa.scalar("\n", pa.large_string()))


def verdicts(found: dict[str, np.ndarray], least: int, repeats: int, lost: int) -> dict[str, np.ndarray]:
    n = found["n_words"]
    failed = (n < least) | (100 * found["n_repeat_words"] > repeats * n)
    return {"base_failed": failed, "kept": ~failed & (100 * (n - found["n_kept_words"]) <= lost * n)}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BYTES of text, or of one row."""
    for b in sliced(batches, 4096):
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


def _clean(least: int, repeats: int, lost: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        found, clean = judged(b.column("text"))
        new = {k: pa.array(v.astype(np.int64)) for k, v in found.items()}
        new |= {k: pa.array(v) for k, v in verdicts(found, least, repeats, lost).items()}
        new["clean_text"] = clean.cast(pa.string())
        yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c not in new} | new)


def clean_lines(docs: DataFrame, least: int = 50, repeats: int = 50, lost: int = MOST_LOST) -> DataFrame:
    """The columns of docs, counts, base_failed, kept and clean_text.

    A line with words goes if it is navigation (separators between few words), heavy in symbols, shouting (runs of ! or ?), short
    without a closing mark, a short line with a boilerplate phrase, or equal to an earlier line; lines_<rule> counts it under
    the first of these. Lines without words stay. base_failed: fewer than `least` words, or more than `repeats` per
    cent of them in three-word windows that occur twice or more. kept: not base_failed, and at most `lost` per cent of the
    words went with their lines.

    Null and empty texts have no words and an empty clean_text, and fail; texts are read whole, of any length; repeated
    rows and rows with a null doc_id are judged like others, so ties do not arise. An empty table gives an
    empty result. Columns named like those of the result are replaced.
    """
    longs = [*COUNTS, *(f"lines_{r}" for r in RULES)]
    new = [*(f"{c} long" for c in longs), "base_failed boolean", "kept boolean", "clean_text string"]
    docs = docs.drop(*(x.split()[0] for x in new))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *new])
    return docs.mapInArrow(partial(_clean, least, repeats, lost), shape)
