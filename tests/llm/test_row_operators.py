"""Quality rules, hard negatives and conversation repair against brute force, and their results for odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediapulse.llm import negatives, queries, repair, rules

SPACE, END = "[\x20\x09-\x0d]", "[.!?]"


# quality rules


def slow_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    hit = {p + j for places in at.values() if len(places) > 1 for p in places for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def counts(texts):
    found, clean = rules.judged(pa.array(texts, pa.string()))
    return [tuple(int(found[c][k]) for c in rules.COUNTS[:5]) for k in range(len(texts))], found, clean.to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b\x0c\x1c\x85é|$", max_size=60)), max_size=5))
def test_base_counts(texts):
    assert counts(texts)[0] == [slow_counts(t) for t in texts]


PROSE = "The harbour was quiet that morning, and nobody on the pier expected the ship to arrive early."
LINES = {
    "navigation": "Home | News | Sport | About us", "symbols": "word$$$ more&&& of*** that%%% kind###",
    "shouting": "BUY!! NOW!! OR!! NEVER!!", "unclosed": "Latest headlines",
    "boilerplate": "We use cookies to improve your visit; read our privacy policy.", "repeated": PROSE,
}


def test_each_rule_takes_its_lines():
    text = "\n".join([PROSE, "", *LINES.values(), "## A markdown heading, closed.", "- a short item of a list,"])
    _, found, clean = counts([text])
    assert {r: int(found[f"lines_{r}"][0]) for r in rules.RULES} == dict.fromkeys(rules.RULES, 1)
    assert clean == ["\n".join([PROSE, "", "## A markdown heading, closed.", "- a short item of a list,"])]


def test_texts_that_lose_too_much_go():
    fine = "\n".join(f"Day{k} brought rain{k} and wind{k} to town{k} by night{k}." for k in range(12))
    menus = "\n".join(f"Item{k} | Page{k} | More{k} | Other{k} words{k}" for k in range(9))
    _, found, _ = counts([fine, fine + "\n" + menus, fine + "\n" + LINES["navigation"], fine[:100]])
    got = rules.verdicts(found, 50, 50, 30)
    assert got["base_failed"].tolist() == [False, False, False, True]
    assert got["kept"].tolist() == [True, False, True, False]


def test_rules_keep_good_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.clean_lines(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert judged and all(r.kept == bool(r.quality) for r in judged)


def test_rules_odd_rows(spark):
    shape = "doc_id long, text string, kept string, clean_text int"
    long = "word " * 200_000 + "end."
    rows = [(1, None, "k", 1), (2, "", "k", 1), (2, "", "k", 1), (None, PROSE * 9, "k", 1), (3, long, "k", 1), (4, " \n\t\n", "k", 1)]
    got = rules.clean_lines(spark.createDataFrame(rows, shape)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and [r.n_words for r in got if r.doc_id == 2] == [0, 0]
    assert (by[1].n_words, by[1].base_failed, by[1].kept, by[1].clean_text) == (0, True, False, "")
    assert by[3].n_words == 200_001 and by[3].base_failed and by[4].clean_text == " \n\t\n"
    assert rules.clean_lines(spark.createDataFrame([], shape)).collect() == []


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(rules, "BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 4, "b" * 4, None, "c" * 30, "d"]})
    assert [b.num_rows for b in rules._parts(iter([batch]))] == [3, 1, 1]


# hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.sampled_from([3, 300, 40_000, 2**22]))
def test_products_are_exact(seed, depth, size):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-size, size + 1, (n, depth)) for n in (3, 4))
    a[0], b[0] = size, -size
    primes = negatives.primes_for(depth * size * size, depth)
    got = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == (a @ b.T).tolist()
    assert all(min(depth, negatives.DEPTH) * (p // 2) ** 2 < 2**24 for p in primes)


def test_long_vectors_are_multiplied_in_parts(monkeypatch):
    monkeypatch.setattr(negatives, "DEPTH", 7)
    rng = np.random.default_rng(1)
    a, b = rng.integers(-900, 900, (2, 5, 40))
    primes = negatives.primes_for(40 * 900 * 900, 40)
    got = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == (a @ b.T).tolist()


def slow_negatives(rows):
    """rows: (vec_id, label, integer vector), ids unique."""
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, k == label) for j, k, w in rows if j != i]
        for p, j in sorted((s, j) for s, j, same in scored if same)[:5]:
            near = sorted((s, k) for s, k, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(near[:5])]
    return sorted(out)


@pytest.mark.parametrize("most,rows_of_block", [(16_384, 2048), (2, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, most, rows_of_block):
    monkeypatch.setattr(negatives, "ROWS", rows_of_block)
    monkeypatch.setattr(negatives, "ANCHORS", 2 if rows_of_block == 3 else 1024)
    rng = random.Random(5)
    rows = [(k * 10, rng.randrange(3), [rng.randrange(-3, 4) for _ in range(4)]) for k in range(90)]
    rows += [(k * 10 + 1, rng.randrange(3), [2, 2, 2, 2]) for k in range(40)]  # ties everywhere
    got = negatives.hard_negatives(
        spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(5), F.col("vec_id") % 100 == 0, most
    )
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows)


def test_negatives_query_against_brute_force(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    got = queries.op12_hard_negatives(spark, sf).collect()
    assert sorted(map(tuple, got)) == slow_negatives(rows)


def test_negatives_odd_rows(spark):
    shape = "vec_id long, embedding array<float>, label int, rank string, score string"
    nan, inf = float("nan"), float("inf")
    fine = [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [0.9, 0.0], 2), (103, [0.95], 2)]
    odd = [
        (104, None, 1), (105, [None, 1.0], 1), (106, [nan, 1.0], 2), (107, [inf, 1.0], 1), (108, [1.0, 1.0], None),
        (None, [1.0, 0.0], 1), (200, [], 3), (101, [1.0, 0.0], 1), (102, [0.9, 0.0], 2), (100, [1.0, 0.0], 1),
    ]
    mine = lambda rows: negatives.hard_negatives(
        negatives.integer_vectors(spark.createDataFrame([(*r, "r", "s") for r in rows], shape)), F.col("vec_id") % 100 == 0
    ).collect()
    want = [(100, 101, 1, 103, 65536, 243 * 256), (100, 101, 2, 102, 65536, 230 * 256)]
    assert sorted(map(tuple, mine(fine))) == want and sorted(map(tuple, mine(fine + odd))) == want
    assert mine([]) == [] and mine(odd[:5]) == []
    with pytest.raises(ValueError, match="fit"):
        mine([(100, [1e30], 1)])


# conversation repair


def brute_audit(rows):
    """All edits with at most two inserts in a row, by the words of the contract."""
    best = None

    def go(k, audit, roles, cost, inserted):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch("s?(ua)*u?", roles):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(k, audit + "I", roles + r, cost + 3, inserted + 1)
        if k < len(rows):
            row = rows[k]
            go(k + 1, audit + "D", roles, cost + 4, 0)
            if not row & 4:
                stays = 3 if row & 8 else 0
                go(k + 1, audit + "K", roles + "xsua"[row & 3], cost + stays, 0)
                for r in "ua":
                    go(k + 1, audit + "R", roles + r, cost + 3 + stays, 0)

    go(0, "", "", 0, 0)
    return best


signs = st.builds(lambda kind, fault: kind | fault, st.integers(0, 3), st.sampled_from([0, 0, 0, 4, 8]))


@settings(max_examples=200, deadline=None)
@given(st.lists(signs, max_size=6).map(bytes))
def test_cheapest_audits(rows):
    assert repair.audit_of(rows) == brute_audit(rows)


def string_audits(rows, state, first):
    """The search with plain strings."""
    live = {state: (0, "")}

    def settle():
        for _ in range(4):
            for s, (cost, audit) in list(live.items()):
                new = (cost + 3, audit + "I")
                live[repair.NEXT[s]] = min(live.get(repair.NEXT[s], new), new)

    if first:
        settle()
    for row in rows:
        best = {}
        for s, (cost, audit) in live.items():
            for more, letter, to in repair.edits(row, s):
                new = (cost + more, audit + letter)
                best[to] = min(best.get(to, new), new)
        live.clear()
        live.update(best)
        settle()
    return live


@settings(max_examples=60, deadline=None)
@given(st.lists(signs, max_size=150).map(bytes), st.integers(0, 3), st.sampled_from([15, 9, 10, 3]))
def test_linked_audits_equal_strings(rows, state, mask):
    rows = bytes(r & mask for r in rows)
    assert repair.solve(rows, state, state == 0) == string_audits(rows, state, state == 0)


def test_colliding_hashes_do_no_harm(monkeypatch):
    rng = random.Random(2)
    cases = [bytes(rng.choice([0, 1, 2, 3, 8]) for _ in range(40)) for _ in range(20)]
    want = [repair.solve(c) for c in cases]
    monkeypatch.setattr(repair, "_MOD", 3)
    assert [repair.solve(c) for c in cases] == want


def slow_repair(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text) by the contract, audits by the search with strings."""
    spaced = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if code == 1 else re.sub(END, "", text) if code == 2 else text
        role = "user" if code == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, code = set(), [], []
        for _, role, text in own:
            bare = re.sub(SPACE + "+$", "", text)
            fault = "b" if not bare else "d" if (role, text) in seen else "" if re.search(END + "$", bare) else "t"
            seen.add((role, text))
            faults.append(fault)
            code.append("xsua".find(role[:1] or "x") * (role[:1] in ("s", "u", "a")) | 4 * (fault in ("b", "d")) | 8 * (fault == "t"))
        roles = [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        ends = string_audits(bytes(code), 0, True)
        cost, audit = min(ends[s] for s in (0, 3) if s in ends)
        left, rest, last = [], iter(own), ""
        for x in audit:
            row = None if x == "I" else next(rest)
            if x == "D":
                continue
            role = row[1] if x == "K" else "assistant" if last[:1] == "u" else "user"
            left.append(f"{role}:{row[2] if row else ''}")
            last = role
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in rows}


def segmented(monkeypatch, segment):
    monkeypatch.setattr(repair, "LARGE", 3)
    monkeypatch.setattr(repair, "SEGMENT", segment)


@pytest.mark.parametrize("segment", [None, 1, 3, 1000])
def test_repair_against_brute_force(spark, sf, monkeypatch, segment):
    if segment:
        segmented(monkeypatch, segment)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.op13_conversation_repair(spark, sf)) == slow_repair(rows)


ODD = [
    (1, None, None, None), (1, None, "user", "Hello."), (1, 5, "user", "Hello."), (1, 9, "tool", "x"), (1, 9, "tool", "x"),
    (None, 1, "user", "Ä?"), (None, None, "", "  \t"), (2, 3, "system", "Be kind.\x0b"), (3, 7, "assistant", "long. " * 50_000),
    (3, 7, "Assistant", "."), (4, -4, "usurper", "z!\n"), (4, 400, "assistant", ""),
] + [(5, t % 7, ["user", "assistant", "system", "tool"][t * t % 4], f"{t % 11}{'.?! '[t % 4]}") for t in range(60)]


@pytest.mark.parametrize("segment", [None, 1, 4, 1000])
def test_repair_odd_rows(spark, monkeypatch, segment):
    if segment:
        segmented(monkeypatch, segment)
    shape = "conv_id long, turn long, role string, text string, cost string, audit int"
    frame = spark.createDataFrame([(*r, "c", 1) for r in ODD], shape).repartition(3)
    damaged = repair.damage(frame)
    assert results(repair.repair(damaged)) == slow_repair(ODD)
    turns = {}
    for r in repair.repair(damaged, turns=True).collect():
        turns.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    text = {c: "\n".join(x for _, x in sorted(t)) for c, t in turns.items()}
    digests = {c: hashlib.sha256(text.get(c, "").encode()).hexdigest() for c in {r[0] for r in ODD}}
    assert digests == {c: r[-1] for c, r in slow_repair(ODD).items()}
    assert repair.repair(repair.damage(spark.createDataFrame([], shape))).collect() == []


def test_large_conversation_in_segments(spark, monkeypatch):
    segmented(monkeypatch, 50)
    rng = random.Random(3)
    rows = [(1, rng.randrange(2000), rng.choice(["user", "assistant", "system"]), rng.choice("ab") + rng.choice([".", ""])) for _ in range(3000)]
    rows += [(1, None, "user", "Same.")] * 500 + [(2, k, "user", f"{k}.") for k in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert results(repair.repair(repair.damage(frame))) == slow_repair(rows)
