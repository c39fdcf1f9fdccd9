"""Operators on documents against brute force, and their defined results for odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from mediapulse.llm import bpe, classlm, decontaminate, licenses, nearcopies, quality, queries, simhash, substring, templates

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, items string, repeats int, fp string, n_words string"
LONG = "very " * 40_000 + "long"
ROWS = [
    (1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p"),
    (2, "a b c d e f g h i j k l m n o p"), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, LONG), (None, "a b c"),
    (None, None),
    (8, "É Ü ß Σ İ <|endoftext|> don't 12  x y é !!"), (9, "line one\nline two\r\nline three\x1cfour\x85five"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "s", "i", 1, "f", "n") for i, t in ROWS], SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_groups(spark, docs, texts):
    got = {r.doc_id: r for r in simhash.simhash_dedup(docs).collect()}
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    linked = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3]
    want = components(list(fp), linked)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.simhash_dedup(odd).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[2]] == [1, 1]
    assert {by[i][0].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {by[i][0].component_id for i in (3, 4, 5)} == {3}
    assert sorted(str(r.component_id) for r in by[None]) == ["3", "None"]
    assert simhash.simhash_dedup(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 7, 8, 9]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4)), min_size=1,
        max_size=60
    )
)
def test_gray_index_finds_all(rows):
    base = {}
    fps = sorted(
        {(b, base.setdefault(b, f) ^ sum(1 << k for k in set(flips))) for b, f, flips in rows},
        key=lambda x: (x[0], gray_rank(x[1]))
    )
    bucket, fp = np.array([x[0] for x in fps]), np.array([x[1] for x in fps], np.uint64)
    i, j = simhash.GrayIndex(bucket, fp).near(np.arange(len(fps)), 3)
    want = {
        (a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if fps[a][0] == fps[b][0] and bin(
            fps[a][1] ^ fps[b][1]
        ).count("1") <= 3
    }
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def gray_rank(x):
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> k
    return x


def test_any_three_bits_leave_two_bands():
    masks = [m % 2**64 for m in simhash.band_masks(3)]
    assert len(masks) == 10 and {bin(m).count("1") for m in masks} <= {25, 26}
    rng = np.random.default_rng(3)
    for bits in rng.integers(0, 64, (500, 3)):
        far = sum(1 << int(b) for b in set(bits))
        assert any(not far & m for m in masks)


def test_hot_bucket_in_blocks(spark):
    # fingerprints that share three bands: their buckets exceed the block size and are dealt out in pairs
    rng = np.random.default_rng(1)
    rows = {int(f): k for k, f in enumerate(rng.integers(0, 1 << 14, 700))}
    reps = spark.createDataFrame(list(rows.items()), "fp long, rep long")
    got = {r.node: r.component for r in simhash.connected_components(simhash.near_links(reps, 3, block=50)).collect()}
    fps = list(rows)
    want = components(
        list(rows.values()),
        [(rows[a], rows[b]) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin(a ^ b).count("1") <= 3]
    )
    assert {k: got.get(k, k) for k in want} == want


def slow_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_one_of_near_copies_stays(spark, texts):
    # copies with single words changed: at 400 words 8 changes leave a similarity of about 0.82, 11 one of 0.76
    rng, rows = np.random.default_rng(6), dict(texts)
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows[100_000 + 10 * g] = " ".join(words)
        for k in range(1, 6):
            changed = words.copy()
            for x in rng.choice(400, 2 * k + 1, replace=False):
                changed[x] = f"v{x}"
            rows[100_000 + 10 * g + k] = " ".join(changed)
    sets = {i: slow_shingles(t) for i, t in rows.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components(list(sets), linked)
    far = [(a, b) for a, b in linked if bin(slow_fingerprint(rows[a]) ^ slow_fingerprint(rows[b])).count("1") > 3]
    assert len(far) > 50
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted(i for i in want if want[i] == i)
    # blocks of about two documents decide the same pairs
    reps, groups = nearcopies.near_copies(frame, block=800)
    later = {r.node for r in groups.collect() if r.node != r.component}
    assert sorted(r.rep for r in reps.collect() if r.rep not in later) == sorted(i for i in want if want[i] == i)


def test_frames_bring_no_sets_together():
    rng = random.Random(4)
    frame = [f"frame{k}" for k in range(100)]
    texts = [" ".join(frame + [f"own{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(500)]
    copies = [t.replace("frame50", f"edit{k}") for k, t in enumerate(texts[:20])]
    sets = [nearcopies.shingle_set(t.encode()) for t in [*texts, *copies]]
    first = nearcopies.joined(sets, 0.8)
    assert first.tolist() == [*range(500), *range(20)]
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owners, bounds, members = nearcopies.prefix_index(flat, size, 0.8)
    pairs = {(i, int(j)) for i, (a, z) in zip(owners.tolist(), bounds) for j in members[a:z] if j > i}
    assert len(pairs) < 200  # of 135,000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=1, max_size=25), st.sampled_from([0.5, 0.8, 1.0]))
def test_prefix_join_against_all_pairs(sets, similarity):
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    label = components(range(len(sets)), near)
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    assert nearcopies.joined(arrays, similarity).tolist() == [label[k] for k in range(len(sets))]


def slow_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_windows(items):
    out = {}
    for i, t in items:
        w = slow_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[k : k + n]), set()).add(i)
    return out


def slow_hits(text, windows):
    w, hit, items = slow_words(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (own := windows.get(tuple(w[k : k + n]))) is not None:
                hit.update(range(k, k + n))
                items |= own
    return w, hit, items


@pytest.mark.parametrize("max_words", [10**6, 300])
def test_decontamination(spark, sf, docs, texts, max_words):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = slow_windows([(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, clean=True, max_words=max_words).collect()}
    hits = 0
    for i, t in texts.items():
        w, hit, items = slow_hits(t, windows)
        hits += bool(hit)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(map(str, items)))
        assert slow_words(got[i].text) == [x for k, x in enumerate(w) if k not in hit]
    assert hits


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame(
        [(1, "b c D"), (2, None), (None, "m n, o"), (3, "!!"), (4, "b c d")], "item_id long, text string"
    )
    rows = decontaminate.decontaminate(odd, bench, clean=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and (by[1].n_hit, by[1].items) == (6, ["1", "4"]) and (
        by[3].n_words, by[3].n_hit
    ) == (0, 0)
    assert by[1].text == "a  e f g h i j k l  p" and by[7].n_words == 40_001
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(odd, bench.limit(0)).collect())


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_matches_the_library(docs, odd, empty):
    t = tokenizer()
    for table in (docs, odd):
        want = Counter()
        for r in table.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[
                r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            ] += 1
        assert Counter(map(tuple, bpe.bpe_encode(table, queries.vocabulary(), digests=True).collect())) == want
        for r in bpe.bpe_encode(table, queries.vocabulary()).collect():
            assert r.decoded == t.decode(r.ids, skip_special_tokens=False)
    assert bpe.bpe_encode(empty, queries.vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(
    st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60) | st.text(
        "aAeé Σσ'st12!<|>endoftxr ́ẞ ", max_size=60
    )
)
def test_bpe_on_any_text(text):
    t = tokenizer() if not hasattr(test_bpe_on_any_text, "t") else test_bpe_on_any_text.t
    test_bpe_on_any_text.t = t
    assert bpe.loaded(queries.vocabulary()).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_within_its_bound():
    b = bpe.WordBpe(queries.vocabulary(), keep=50)
    for k in range(20):
        b.encode(" ".join(f"w{k}x{j}" for j in range(20)))
        assert len(b.known) <= 70


def test_quality_separates_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).join(
        labels.groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "y"), "doc_id"
    ).collect()
    good, bad = [r.score for r in scored if r.y == 1], [r.score for r in scored if r.y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([(r.score >= 0.3) == r.y for r in held]) > 0.9


def test_votes_against_brute_force(spark, sf, docs, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    voter = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(voter.y) > 25
    for i, t in texts.items():
        x = quality.features((t or "").encode()) * voter.idf
        v = (x / max(np.linalg.norm(x), 1e-12)) @ voter.axes
        v = v / max(np.linalg.norm(v), 1e-12)
        ranked = sorted(((float(v @ voter.known[:, k]), k) for k in range(len(voter.y))), reverse=True)
        last = ranked[24][0]
        weigh = [
            (max(0.0, min(1.0, s)) ** quality.POWER * voter.weight[k], voter.y[k]) for s,
            k in ranked if s >= last - 1e-6
        ]
        want = (sum(w * y for w, y in weigh) + 0.05 * voter.prior) / (sum(w for w, _ in weigh) + 0.05)
        assert got[i].score == pytest.approx(want, abs=2e-3) and got[i].predicted == (got[i].score >= 0.3)


def test_neighbours_that_tie_all_vote():
    x = np.zeros((40, quality.TERMS + quality.RATES), np.float32)
    x[:, 5] = 1
    y = np.r_[np.zeros(20, int), np.ones(20, int)]
    assert quality.Voter(x, y, {0: 20, 1: 20}).score(x[:1])[0] == pytest.approx(0.5)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (7, 0, 1), (None, 1, 0), (8, None, 0), (6, 0, 0)],
        "doc_id long, quality int, toxic int"
    )
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def slow_windows_of(raw):
    """(first byte, byte after, word spans) of every window of a text, by the definition."""
    words = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
    padded = b" " * 16 + raw
    h = [sum(int(substring._GEAR[padded[15 + a - k]]) << k for k in range(16)) % 65536 for a, _ in words]
    cut = [
        k for k in range(len(h)) if k == 0 or all(h[k] < h[x] for x in range(max(0, k - 3), k)) and all(
            h[k] <= h[x] for x in range(k + 1, min(len(h), k + 4))
        )
    ]
    starts = sorted({x for a, z in zip(cut, [*cut[1:], len(h)]) for x in range(a, z, 64)})
    edges, found = [*starts, len(h)], []
    for k in starts:
        if ends := [e for e in edges if e - k >= 20]:
            found.append((k, ends[0]))
    late = [k for k in starts if len(h) - k >= 20]
    if late and (late[-1], len(h)) not in found:
        found.append((late[-1], len(h)))
    return words, found


def slow_substring(rows):
    """Of equal windows the first stays; words under later ones go, with the blanks behind them."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        raw = (t or "").encode()
        words, found = slow_windows_of(raw)
        gone = set()
        for a, z in found:
            piece = raw[words[a][0] : words[z - 1][1]]
            if piece in seen:
                gone.update(range(a, z))
            seen.add(piece)
        if not gone:
            out[i] = t
            continue
        ends = [words[k + 1][0] if k + 1 < len(words) else len(raw) for k in range(len(words))]
        out[i] = (
            raw[: words[0][0]] + b"".join(raw[words[k][0] : ends[k]] for k in range(len(words)) if k not in gone)
        ).strip().decode()
    return out


def test_substring_against_brute_force(docs, texts):
    got = {r.doc_id: r.text for r in substring.substring_dedup(docs).collect()}
    want = slow_substring(texts)
    assert got == want and sum(got[i] != texts[i] for i in got) > 5


def test_substring_shifts_and_odd_rows(spark, odd, empty):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, "start " + passage + " end of it", "x"), (2, "another lead in here: " + passage, "y"),
        (3, "clean text of its own", None), (3, "clean text of its own", None), (None, None, None)
    ]
    got = substring.substring_dedup(
        spark.createDataFrame(rows, "doc_id long, text string, n_removed_runs string")
    ).collect()
    text = {r.doc_id: r.text for r in got}
    assert text[1] == rows[0][1] and text[3] == rows[2][1] and text[None] is None and len(got) == 5
    assert text[2].startswith("another lead in here:") and len(text[2].split()) < 30
    after = {r.doc_id: r for r in substring.substring_dedup(odd).collect()}
    assert len(
        after[7].text
    ) < 30_000 and after[7].text.startswith("very very") and after[4].text == "" and after[3].text is None
    assert substring.substring_dedup(empty).count() == 0


def test_mosaics_of_short_phrases_stay(spark):
    # every phrase of eight words occurred before, but no passage of twenty words did
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"w{x}" for x in rng.integers(0, 500, 8)) for _ in range(40)]
    rows = [(k, " ".join(rng.permutation(phrases)[:12])) for k in range(60)]
    got = {
        r.doc_id: r for r in substring.substring_dedup(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    again = {i for i, r in got.items() if r.n_removed_runs}
    pieces = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 19):
            pieces.setdefault(tuple(w[k : k + 20]), i)
    true = {i for i, t in rows for k in range(len(t.split()) - 19) if pieces[tuple(t.split()[k : k + 20])] < i}
    assert again <= true


def test_every_occurrence_but_the_first_of_a_hot_passage_goes(spark):
    passage = " ".join(f"hot{k}" for k in range(60))
    rows = [(k, " ".join(f"own{k}_{x}" for x in range(k % 30)) + " " + passage + f" tail{k}") for k in range(600)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert [r.doc_id for r in got if not r.n_removed_runs] == [0] and all(
        len(r.text.split()) < len(rows[r.doc_id][1].split()) - 30 for r in got if r.doc_id
    )


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab cde\n é", max_size=200), max_size=4), st.integers(1, 6))
def test_layouts_are_ordered_and_whole(found, least):
    raw = [t.encode() for t in found]
    layout = substring.Layout(raw, least)
    for k, t in enumerate(raw):
        none = np.zeros(layout.chunks[k + 1] - layout.chunks[k], bool)
        assert layout.without(k, none) == (t.strip(), 0, 0)
        assert layout.without(k, ~none)[2] == len(t.split())
    for text, place, a, z in zip(*layout.windows()):
        assert len(layout.buffer[a:z].split()) >= least and layout.buffer[a:z] in raw[text] and place >= 0
    assert np.diff(layout.word).max(initial=0) <= 64


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def slow_class_scores(texts, class_of, kinds):
    """(base, score) of every text from its definition, with the words' classes given."""
    end, unknown = kinds + 1, kinds + 2
    split = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    train = [w for i, w in split.items() if not is_held_out(i)]
    c = Counter(w for words in train for w in words)
    total, below = sum(c.values()) + len(train), sum(c.values()) + len(train) + 0.5 * (len(c) + 1 + 1)
    sizes, once = [0] * (kinds + 1), [0.5] * (kinds + 1)
    for w, n in c.items():
        sizes[class_of[w]] += n
        once[class_of[w]] += n == 1
    moves = Counter()
    for words in train:
        row = [end, *(class_of[w] for w in words), end]
        moves.update(zip(row, row[1:]))
    states = kinds + 2
    every = sum(moves.values())
    share = [(sum(moves[a, b] for a in range(states)) + 0.5) / (every + 0.5 * states) for b in range(states)]

    def step(a, b):
        if b == unknown:
            return sum(step(a, k) * once[k] / (sizes[k] + once[k]) for k in range(kinds + 1))
        if a == unknown:
            return share[b]
        return (moves[a, b] + classlm.STRENGTH * share[b]) / (
            sum(moves[a, k] for k in range(states)) + classlm.STRENGTH
        )

    step_of, out = {}, {}
    for i, words in split.items():
        row = [end, *(class_of.get(w, unknown) for w in words), end]
        score = sum(math.log10(step_of.setdefault(p, step(*p))) for p in zip(row, row[1:]))
        score += sum(math.log10(c[w] / (sizes[class_of[w]] + once[class_of[w]])) for w in words if w in c)
        base = sum(math.log10((c[w] + 0.5) / below) for w in words) + math.log10((len(train) + 0.5) / below)
        out[i] = (len(words) + 1, sum(w in c for w in words) + 1, total, base, score)
    return out


@pytest.mark.parametrize("head", [100_000, 50, 0])
def test_class_model(spark, docs, texts, head):
    kinds = 7
    words = {w for t in texts.values() for w in (t or "").encode().lower().split()}
    class_of = {w: classlm.word_key(w) % (kinds + 1) for w in words}
    given = lambda vocab: vocab.select(classlm._key_of("word").alias("word_key")).selectExpr(
        "word_key", f"cast(word_key % {kinds + 1} as int) as class"
    )
    got = {r.doc_id: r for r in classlm.class_model_scores(docs, classes=kinds, head=head, clusters=given).collect()}
    known_words = trained(texts)
    want = slow_class_scores(texts, {w: c for w, c in class_of.items() if w in known_words}, kinds)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, is_held_out(i))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-6)


def trained(texts):
    return {w for i, t in texts.items() if not is_held_out(i) for w in (t or "").encode().lower().split()}


def test_class_model_beats_the_base(docs):
    rows = classlm.class_model_scores(docs, core=200, seed=100).collect()
    for held in (True, False):
        assert sum(r.score for r in rows if r.held_out == held) > 0.95 * sum(
            r.base_score for r in rows if r.held_out == held
        )


@pytest.mark.parametrize("head", [100_000, 30, 0])
def test_every_word_has_a_class_from_all_its_neighbours(spark, docs, texts, head):
    train = docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 1").select("text")
    words = train.mapInArrow(classlm._count, "word string, n long").groupBy("word").agg({"n": "sum"}).toDF("word", "n")
    kinds, rng = 6, random.Random(1)
    keys = sorted(classlm.word_key(w) for w in trained(texts))
    start = {k: rng.randrange(kinds) for k in keys if rng.random() < 0.8}
    table = classlm.written(spark.createDataFrame(list(start.items()), "word_key long, class int"), "start")
    found = {r.word_key: r["class"] for r in classlm._over_all_neighbours(train, words, table, kinds, head).collect()}
    width, beside = kinds + 2, {}
    for i, t in texts.items():
        row = [None, *map(classlm.word_key, (t or "").encode().lower().split()), None]
        kind = [kinds + 1 if w is None else start.get(w, kinds) for w in row]
        for k in range(1, len(row) - 1):
            if not is_held_out(i):
                cell = beside.setdefault(row[k], Counter())
                cell[kind[k - 1]] += 1
                cell[width + kind[k + 1]] += 1
    grid = np.zeros((kinds, 2 * width))
    for w, cell in beside.items():
        for x, n in cell.items():
            if w in start:
                grid[start[w], x] += n
    log_p = classlm.likelihoods(grid)
    assert found.keys() == beside.keys() == set(keys)
    for w, cell in beside.items():
        value = sum(n * log_p[:, x] for x, n in cell.items())
        assert value[found[w]] == pytest.approx(value.max(), rel=1e-5)


def cells_of(batches):
    """(word_key, neighbour) to count, and the rows, of batches of packed cells."""
    found, rows = Counter(), []
    for b in batches:
        b = b.filter(b.column("x").is_valid())
        (x, ends), (n, _) = classlm._values(b.column("x"), "<u2"), classlm._values(b.column("n"), "<u4")
        rows += b.column("word_key").to_pylist()
        for w, a, z in zip(b.column("word_key").to_pylist(), ends, ends[1:]):
            for k in range(a, z):
                found[w, int(x[k])] += int(n[k])
    return found, rows


def test_neighbours_are_dealt_as_one_row_for_each_word():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e f g Z".split()) for _ in range(rng.randrange(40))) for _ in range(30)]
    named, width, want, beside = {b"a": 0, b"b": 1, b"c": 0}, 4, Counter(), Counter()
    for t in texts:
        row = [None, *t.lower().encode().split(), None]
        for side, w, x in [(0, b, a) for a, b in zip(row, row[1:])] + [(width, a, b) for a, b in zip(row, row[1:])]:
            if w is not None and (x is None or x in named):
                want[classlm.word_key(w), side + (width - 1 if x is None else named[x])] += 1
            elif w is not None:
                beside[classlm.word_key(w), side, classlm.word_key(x)] += 1
    batch = pa.RecordBatch.from_pydict({"text": texts})
    share = SimpleNamespace(value=classlm._named([*named, b"d"], [*named.values(), -1]))
    for others in (False, True):
        out = list(classlm._neighbours(share, width, others, iter([batch])))
        found, rows = cells_of(out)
        assert found == want and len(rows) == len(set(rows)) == len({w for w, _ in want})
        rest = [r for b in out for r in b.to_pylist() if r.get("other") is not None]
        assert {(r["word_key"], r["side"], r["other"]): r["m"] for r in rest} == (beside if others else {})

    two = pa.Table.from_batches(next(classlm._neighbours(share, width, False, iter([batch.slice(k, 15)]))) for k in (0, 15))
    packed = list(classlm._packed(two.sort_by("word_key").to_batches(max_chunksize=3)))
    found, rows = cells_of(packed)
    assert found == want and rows == sorted(set(rows))
    cells = [(w << classlm._BITS | x, n) for (w, x), n in want.items()] * 2
    key, n = (pa.array(c, pa.int64()) for c in zip(*cells))
    found, rows = cells_of(classlm._folded(iter([pa.RecordBatch.from_arrays([key, n], names=["key", "n"])])))
    assert found == want + want and len(rows) == len(set(rows))


def test_all_words_are_clustered(spark, docs, texts):
    train = docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 1").select("text")
    words = train.mapInArrow(classlm._count, "word string, n long").groupBy("word").agg({"n": "sum"}).toDF("word", "n")
    found = classlm._clustered(train, words, 50, 20, 6).collect()
    assert {r["class"] for r in found} <= set(range(6)) and len(found) == len(trained(texts))
    assert {r.word_key for r in found} == {classlm.word_key(w) for w in trained(texts)}


def test_words_take_the_class_of_greatest_likelihood():
    rng = np.random.default_rng(2)
    log_p, neighbour, n = np.log(rng.random((5, 9))), rng.integers(0, 9, 200), rng.integers(1, 9, 200)
    starts = np.array([0, 1, 50, 51, 120])
    best, value = classlm.choose(starts, neighbour, n, log_p)
    for k, (a, z) in enumerate(zip(starts, [*starts[1:], 200])):
        want = [sum(n[x] * log_p[c, neighbour[x]] for x in range(a, z)) for c in range(5)]
        assert best[k] == int(np.argmax(want)) and value[k] == pytest.approx(max(want), rel=1e-5)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**32))
def test_class_model_sums_to_one(kinds, seed):
    rng = np.random.default_rng(seed)
    moves, sizes = rng.integers(0, 9, (kinds + 1, kinds + 1)).astype(float), rng.integers(0, 50, kinds).astype(float)
    once = np.minimum(sizes, rng.integers(0, 9, kinds)) + 0.5
    p = 10 ** classlm.transitions(moves, once, sizes)
    known = p[:, :kinds] @ (sizes / (sizes + once))
    assert np.allclose(known + p[:, kinds] + p[:, kinds + 1], 1)


def likelihood(pairs, own):
    n = max(own) + 1
    grid = np.zeros((n, n))
    for a in range(len(own)):
        for b in range(len(own)):
            grid[own[a], own[b]] += pairs[a, b]
    f = lambda x: float(np.sum(x * np.log(np.maximum(x, 1e-300))))
    return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1))


def test_exchange_ends_where_no_word_gains():
    rng = np.random.default_rng(4)
    pairs = np.zeros((13, 13))
    pairs[:6, 6:12] = rng.integers(1, 20, (6, 6))
    pairs[6:12, :6] = rng.integers(1, 20, (6, 6))
    pairs[12, :6], pairs[6:12, 12], pairs[3, 3] = 4, 3, 7
    own = classlm.exchange(pairs, classes=3)
    assert own[12] == 3 and set(own[:12]) <= {0, 1, 2}
    best = likelihood(pairs, own)
    assert best > likelihood(pairs, [*(k % 3 for k in range(12)), 3])
    for w in range(12):
        for c in range(3):
            moved = own.copy()
            moved[w] = c
            assert likelihood(pairs, moved) <= best + 1e-9


def test_class_model_odd_rows(odd, empty):
    rows = classlm.class_model_scores(odd).collect()
    assert len(rows) == len(ROWS) and all(r.held_out for r in rows if r.doc_id is None) and {
        r.n_tokens for r in rows if r.doc_id in (3, 4, 5)
    } == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert classlm.class_model_scores(empty).count() == 0


def test_license_scan(docs, texts):
    got = {(r.doc_id, r.template) for r in licenses.license_scan(docs).collect()}
    want = set()
    for name, notice in templates.TEMPLATES:
        w = slow_words(notice)
        n = min(5, len(w))  # a template of fewer words than a shingle stands anywhere as it is
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, t in texts.items():
            x = slow_words(t)
            if len(own & {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}) / len(own) >= 0.8:
                want.add((i, name))
    assert got == want and got


def test_whole_licences_and_edited_copies(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    filler = " ".join(f"filler{k}" for k in range(400))
    for k, (name, text) in enumerate(templates.TEMPLATES):
        w = text.split()
        if len(w) < 60:
            continue
        for x in rng.choice(len(w), len(w) // 60, replace=False):  # an edit spoils five shingles
            w[x] = f"edited{x}"
        rows += [(2 * k, f"{filler} {text} {filler}"), (2 * k + 1, f"{filler} {' '.join(w)} {filler}")]
        want |= {2 * k: name, 2 * k + 1: name}
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.template): r for r in got}
    assert len(want) > 12 and all((i, name) in found for i, name in want.items())
    assert all(abs(found[i, name].first_word - 400) <= 5 for i, name in want.items())
    assert not any(r.template == "bsd-2-clause" and want[r.doc_id] == "mit" for r in got)


def test_license_scan_odd_rows(spark, odd, empty):
    long = " ".join(f"term{k}" for k in range(100))
    changed = long.replace("term50 ", "other ")
    notices = [("short", "one"), ("long", long), ("blank", "!!")]
    rows = [
        (1, "x " * 300 + changed + " y" * 10), (2, "one"), (3, "one two"), (4, None),
        (None, long + " z" * 300 + " " + long)
    ]
    got = sorted(
        (str(r.doc_id), r.template, round(r.containment, 2), r.first_word, r.end_word) for r in licenses.license_scan(
            spark.createDataFrame(rows, "doc_id long, text string"), notices
        ).collect()
    )
    assert got == [
        ("1", "long", 0.95, 300, 400), ("2", "short", 1.0, 0, 1), ("3", "short", 1.0, 0, 1), ("None", "long", 1.0, 0, 100),
        ("None", "long", 1.0, 400, 500)
    ]
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(
            odd,
            spark.createDataFrame(
                [("t", "x" * (2 * licenses.MAX_TEMPLATE_WORDS + 1))], "template string, text string"
            )
        )
