"""Conversation repair: the cheapest edits that make the roles of a conversation alternate, and their audit.

The edits of a conversation are a path through four states (nothing yet, after a system, user or assistant turn). Partial
audits are nodes of a tree that share their prefixes; each node knows its ancestors 2^k steps back and the rolling hash of its
letters, so two audits of equal cost are compared at the end of their longest common prefix, found by lifting.

Conversations are sorted runs of rows in their task. Those above LARGE rows or BYTES of text go another way: range-sorted
segments, which any task can work on, give the best audits between any two states; these are joined up segment by
segment, and the repaired text passes through its digest as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A conversation above either is repaired in segments of SEGMENT rows.
LARGE, BYTES, SEGMENT = 20_000, 64_000_000, 8_192
#: Fixed: costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fixed: white space.
_BLANKS = " \t\n\r\x0b\x0c"
_MOD, _BASE = (1 << 61) - 1, 0x5BD1E995
#: States; the next user or assistant turn leads from each to NEXT.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}


class Audits:
    """Audits as nodes of one tree; node 0 is the empty one."""

    def __init__(self):
        self.up: list[list[int]] = [[]]
        self.depth, self.letter, self.hash = [0], [""], [0]

    def node(self, parent: int, letter: str) -> int:
        """The parent's audit with one more letter; up[k] is the ancestor 2^k steps back."""
        up, k, at = [parent], 0, parent
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.up.append(up)
        self.depth.append(self.depth[parent] + 1)
        self.letter.append(letter)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        return len(self.depth) - 1

    def lifted(self, a: int, depth: int) -> int:
        over = self.depth[a] - depth
        k = 0
        while over:
            if over & 1:
                a = self.up[a][k]
            over >>= 1
            k += 1
        return a

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of one length are equal; equal hashes are checked letter by letter."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def fork(self, a: int, b: int) -> tuple[int, int]:
        """Of two different audits of one length, the nodes after their longest common prefix."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether audit a with letter x comes before audit b with letter y."""
        at = min(self.depth[a], self.depth[b])
        p, q = self.lifted(a, at), self.lifted(b, at)
        if not self.same(p, q):
            p, q = self.fork(p, q)
            return self.letter[p] < self.letter[q]
        if self.depth[a] == self.depth[b]:
            return x < y
        longer = self.letter[self.lifted(a if self.depth[a] > at else b, at + 1)]
        return longer < y if self.depth[a] > at else x <= longer

    def text(self, a: int) -> str:
        out = []
        while a:
            out.append(self.letter[a])
            a = self.up[a][0]
        return "".join(reversed(out))


def edits(row: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, state after) of the edits of one row; see signature() for `row`."""
    kind, gone, cut = row & 3, row & 4, TRUNCATED if row & 8 else 0
    out = [(DELETE, "D", state)]
    if not gone:
        out.append((REROLE + cut, "R", NEXT[state]))
        if kind == SYSTEM and state == START:
            out.append((cut, "K", SYSTEM))
        elif kind in (USER, ASSISTANT) and NEXT[state] == kind:
            out.append((cut, "K", kind))
    return out


def _settle(live: dict[int, tuple[int, int]], tree: Audits) -> None:
    """Insert turns as long as that is the best way to a state."""
    changed = True
    while changed:
        changed = False
        for state, (cost, node) in sorted(live.items(), key=lambda x: x[1][0]):
            to, cost = NEXT[state], cost + INSERT
            old = live.get(to)
            if old is None or cost < old[0]:
                better = True
            else:
                mine = (tree.up[old[1]][0], tree.letter[old[1]]) if old[1] else None
                better = cost == old[0] and mine is not None and mine != (node, "I") and tree.less(node, "I", *mine)
            if better:
                live[to] = (cost, tree.node(node, "I"))
                changed = True


def solve(rows: bytes, state: int = START, first: bool = True) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the best edits of some rows from one state; only the first rows of a conversation may
    insert before themselves, as others' predecessors insert after theirs."""
    tree, live = Audits(), {state: (0, 0)}
    if first:
        _settle(live, tree)
    for row in rows:
        best: dict[int, tuple[int, int, str]] = {}
        for at, (cost, node) in live.items():
            for more, letter, to in edits(row, at):
                old, total = best.get(to), cost + more
                if old is None or total < old[0] or total == old[0] and tree.less(node, letter, old[1], old[2]):
                    best[to] = (total, node, letter)
        live = {to: (cost, tree.node(node, letter)) for to, (cost, node, letter) in best.items()}
        _settle(live, tree)
    return {to: (cost, tree.text(node)) for to, (cost, node) in live.items()}


def cheapest(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """A conversation may end with nothing, or after an assistant's turn."""
    return min(ends[s] for s in (START, ASSISTANT) if s in ends)


@lru_cache(maxsize=65_536)
def _short_audit(rows: bytes) -> tuple[int, str]:
    return cheapest(solve(rows))


def audit_of(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation. Short ones are remembered by their rows' signatures."""
    return _short_audit(rows) if len(rows) <= 64 else cheapest(solve(rows))


def replayed(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves of rows (role, text)."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield letter, role, text


BLANK, DUPLICATE, TRUNC = 1, 2, 3


def fault(text: str, seen: bool) -> int:
    bare = text.rstrip(_BLANKS)
    return BLANK if not bare else DUPLICATE if seen else TRUNC if bare[-1] not in ".!?" else 0


def signature(role: str, faulty: int) -> int:
    """A row as the search sees it: its role's initial, whether it must go, whether it is truncated."""
    kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], 0)
    return kind | 4 * (faulty in (BLANK, DUPLICATE)) | 8 * (faulty == TRUNC)


class Facts:
    """Counts of a run of rows in order."""

    def __init__(self):
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, faulty: int) -> None:
        self.faults[faulty] += 1
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        else:
            self.first = role[:1]
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


_SUMMARY = [*(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
_TURN = ["position long", "edit string", "role string", "text string"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of a task's sorted rows, rows as (turn, role, text), copies written out."""
    own, rows = None, None
    for b in batches:
        for conv, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in _ROW)):
            if rows is None or conv != own:
                if rows is not None:
                    yield own, rows
                own, rows = conv, []
            rows.extend([(turn, role, text)] * copies)
    if rows is not None:
        yield own, rows


_ROW = ["conv_id", "turn", "role", "text", "copies"]


def _repaired(rows: list[tuple]) -> tuple[Facts, int, str]:
    facts, seen, signs = Facts(), set(), bytearray()
    for turn, role, text in rows:
        faulty = fault(text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, role, faulty)
        signs.append(signature(role, faulty))
    return facts, *audit_of(bytes(signs))


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def _small(kind: pa.DataType, turns: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind if k == 0 else None) for k, c in enumerate(columns)],
            names=["conv_id", *((x.split()[0] for x in _TURN) if turns else _NAMES)],
        )

    size = 0
    for conv, rows in _runs(batches):
        facts, cost, audit = _repaired(rows)
        left = replayed(audit, ((role, text) for _, role, text in rows))
        if turns:
            for k, x in enumerate(left):
                out.append((conv, k, *x))
                size += len(x[2])
        else:
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in left).encode()).hexdigest()
            out.append(
                (conv, _gaps(facts.low, facts.high, facts.turns), *facts.faults[1:], facts.illegal, cost, audit, digest)
            )
        if len(out) >= 4096 or size > 4_000_000:
            yield batch()
            size = 0
    if out:
        yield batch()


_NAMES = [*(x.split()[0] for x in _SUMMARY), "audit", "repaired_sha256"]


def _segments(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their segment and place in it; a segment belongs to one conversation and one task."""
    task = TaskContext.get().partitionId() << 32
    own, segment, place = None, -1, SEGMENT
    for b in batches:
        out: dict[str, list] = {c: [] for c in (*_ROW, "first", "segment", "place")}
        for conv, turn, role, text, copies, first in zip(*(b.column(c).to_pylist() for c in (*_ROW, "first"))):
            while copies:
                if place >= SEGMENT or segment < 0 or conv != own:
                    own, segment, place = conv, segment + 1, 0
                n = min(copies, SEGMENT - place)
                for c, v in zip(out, (conv, turn, role, text, n, first, task + segment, place)):
                    out[c].append(v)
                copies, place, first = copies - n, place + n, False
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types)]
        yield pa.RecordBatch.from_arrays(arrays, names=list(out))


def _segment_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[tuple]]]:
    own, rows = None, []
    for b in batches:
        names = ("conv_id", "segment", "turn", "role", "text", "copies", "first")
        for conv, segment, *row in zip(*(b.column(c).to_pylist() for c in names)):
            if own != (conv, segment):
                if rows:
                    yield *own, rows
                own, rows = (conv, segment), []
            rows.append(row)
    if rows:
        yield *own, rows


def _matrices(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment its counts, and the cost and audit of the best edits between any two states."""
    for conv, segment, rows in _segment_runs(batches):
        facts, signs = Facts(), bytearray()
        for turn, role, text, copies, first in rows:
            for k in range(copies):
                faulty = fault(text, not (first and k == 0))
                facts.add(turn, role, faulty)
                signs.append(signature(role, faulty))
        ways = [
            {"start": s, "end": e, "cost": cost, "audit": audit}
            for s in range(4) for e, (cost, audit) in solve(bytes(signs), s, False).items()
        ]
        row = {
            "conv_id": conv, "segment": segment, "blank": facts.faults[BLANK], "duplicate": facts.faults[DUPLICATE],
            "truncated": facts.faults[TRUNC], "illegal": facts.illegal, "turns": facts.turns, "low": facts.low,
            "high": facts.high, "head": facts.first, "tail": facts.last, "ways": ways,
        }
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), _matrix(kind))], names=list(row))


def _matrix(kind: pa.DataType) -> list[pa.DataType]:
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return [kind, *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(way)]


_MATRIX = (
    "segment long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, "
    "tail string, ways array<struct<start int, end int, cost long, audit string>>"
)


class Chain:
    """An audit as a chain of segments' audits."""

    def __init__(self, before: Chain | None, state: int, part: str):
        self.before, self.state, self.part = before, state, part

    def parts(self, until: Chain | None = None) -> list[Chain]:
        out, at = [], self
        while at is not until:
            out.append(at)
            at = at.before
        return out[::-1]


def _joined(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, segment, state, audit, and the conversation's counts) for each segment of the best way through all."""

    def shared(a: Chain, b: Chain) -> Chain | None:
        while a is not b:  # chains of one length
            a, b = a.before, b.before
        return a

    def text(chain: Chain, until: Chain | None) -> str:
        return "".join(x.part for x in chain.parts(until))

    def done(conv, segments, live, counts) -> pa.RecordBatch:
        ends = {s: (cost, chain) for s, (cost, chain) in live.items() if s in (START, ASSISTANT)}
        cost = min(c for c, _ in ends.values())
        chain = min((x for c, x in ends.values() if c == cost), key=lambda x: text(x, None))
        parts = chain.parts()
        if len(parts) > len(segments):  # what is inserted before all rows
            parts[1].part, parts[1].state = parts[0].part + parts[1].part, parts[0].state
            parts = parts[1:]
        n = len(parts)
        columns = {
            "conv_id": pa.array([conv] * n, kind), "segment": pa.array(segments, pa.int64()),
            "state": pa.array([x.state for x in parts], pa.int32()), "audit": pa.array([x.part for x in parts], pa.string()),
            "cost": pa.array([cost] * n, pa.int64()),
        }
        columns |= {k: pa.array([v] * n, pa.int64()) for k, v in counts.items()}
        return pa.RecordBatch.from_pydict(columns)

    own = live = None
    for b in batches:
        for r in b.to_pylist():
            if live is None or r["conv_id"] != own:
                if live is not None:
                    yield done(own, segments, live, counts)
                own, segments, tail, low, high, turns = r["conv_id"], [], None, None, None, 0
                counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
                live = {s: (c, Chain(None, START, a)) for s, (c, a) in solve(b"").items()}
            segments.append(r["segment"])
            for k in ("blank", "duplicate", "truncated", "illegal"):
                counts[k] += r[k]
            counts["illegal"] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
            tail = r["tail"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = (r["low"] if low is None else low), r["high"]
            counts["gaps"] = _gaps(low, high, turns)
            best: dict[int, tuple[int, Chain]] = {}
            for way in r["ways"]:
                if way["start"] not in live:
                    continue
                cost, chain = live[way["start"]]
                new, old = (cost + way["cost"], Chain(chain, way["start"], way["audit"])), best.get(way["end"])
                if old is None or new[0] < old[0]:
                    best[way["end"]] = new
                elif new[0] == old[0]:
                    until = shared(chain, old[1].before)
                    if text(new[1], until) < text(old[1], until):
                        best[way["end"]] = new
            live = best
    if live is not None:
        yield done(own, segments, live, counts)


def _streamed(kind: pa.DataType, turns: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large conversations, whose sorted rows bring their segment's audit along, through replay and digest."""
    names = ("conv_id", "segment", "role", "text", "copies", "audit", "state", *_NAMES[:-2])

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in names))

    def flushed(out):
        arrays = [pa.array([x[k] for x in out], t) for k, t in enumerate([kind, pa.int64(), *[pa.string()] * 3])]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *(x.split()[0] for x in _TURN)])

    own, audit, out = None, [], []
    digest, position = hashlib.sha256(), 0

    def summary():
        values = [*own[1], "".join(audit), digest.hexdigest()]
        arrays = [pa.array([own[0]], kind), *(pa.array([v], pa.int64() if k < 6 else pa.string()) for k, v in enumerate(values))]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_NAMES])

    def of_segment(first, rest):
        """The (role, text) of one segment's rows; the next segment's first row is put into `after`."""
        r = first
        while True:
            for _ in range(r[4]):
                yield r[2], r[3]
            r = next(rest, None)
            if r is None or r[:2] != first[:2]:
                after.append(r)
                return

    rest, after = rows(), []
    r = next(rest, None)
    while r is not None:
        if own is None or own[0] != r[0]:
            if own is not None and not turns:
                yield summary()
            own, audit, position, digest = (r[0], r[7:]), [], 0, hashlib.sha256()
        if not turns:
            audit.append(r[5])
        lines = of_segment(r, rest)
        for edit, role, text in replayed(r[5], lines, r[6]):
            if turns:
                out.append((own[0], position, edit, role, text))
                if len(out) >= 4096:
                    yield flushed(out)
                    out = []
            else:
                digest.update(f"\n{role}:{text}".encode() if position else f"{role}:{text}".encode())
            position += 1
        for _ in lines:
            pass
        r = after.pop()
    if out:
        yield flushed(out)
    if own is not None and not turns:
        yield summary()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations(conv_id, turn, role, text), a twentieth of the rows each
    dropped (no copies), emptied, stripped of end marks, repeated (two copies) and given to the user.

    crc32(conv_id:turn) decides; nulls in it, in roles and in texts become one space, in conv_id and turn they stay.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def _large(rows: DataFrame, kind: pa.DataType, name: str, turns: bool, shape: str) -> DataFrame:
    """The repair of large conversations; rows that are equal become one with their copies summed."""
    keys = ["conv_id", "turn", "role", "text"]
    once = rows.where("copies > 0").groupBy(*keys).agg(F.sum("copies").alias("copies"))
    once = once.withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    early = once.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("early"))
    a, b = once.alias("a"), early.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (
        F.col("a.digest") == F.col("b.digest")
    )
    first = F.col("early.turn").eqNullSafe(F.col("a.turn")).alias("first")
    marked = a.join(b, same).select(*(f"a.{c}" for c in keys), "a.copies", first)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    marked = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    cells = f"conv_id {name}, turn long, role string, text string, copies long, first boolean, segment long, place long"
    cut = written(marked.mapInArrow(partial(_segments, kind), cells), "segments")
    by_segment = cut.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    ways = by_segment.mapInArrow(partial(_matrices, kind), f"conv_id {name}, {_MATRIX}")
    ways = ways.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chosen = f"conv_id {name}, segment long, state int, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
    best = written(ways.mapInArrow(partial(_joined, kind), chosen), "audits").withColumnsRenamed({"conv_id": "c", "segment": "s"})
    whole = cut.join(
        best, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")) & (F.col("place") == 0), "left"
    )
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place")
    return whole.mapInArrow(partial(_streamed, kind, turns), shape)


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """One row of each conversation: gaps, counts of faults, cost and audit of the cheapest repair, digest of its text.

    rows(conv_id, turn, role, text, copies) as damage() gives them; a conversation's rows are taken by turn, nulls first, then
    by role and text, copies side by side. Each row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (no end mark). Keep costs 0, Rerole 3, Delete 4 (the only edit of blank and duplicate rows), Insert 3, a
    truncated row that stays 3; the roles left are `(s?(ua)+)?` by their initials. Of the cheapest repairs the one whose audit
    is least in ASCII counts. With `turns` the result is the repaired turns instead: (conv_id, position, edit, role, text).

    A null conv_id is a conversation like others; of one without any copies the counts are zero and the audit is empty. Null
    roles and texts count as one space. Roles that begin with other letters are reroled or deleted. Repeated rows are
    rows; further columns are not read, so names cannot clash; an empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType
    name, arrow = kind.simpleString(), rows.select("conv_id").limit(0).toArrow().schema[0].type
    spaced = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    rows = rows.select(*_ROW).withColumns(spaced)
    last = ", ".join(_TURN if turns else [*_SUMMARY, "audit string", "repaired_sha256 string"])
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = written(size.where((F.col("n") > LARGE) | (F.col("bytes") > BYTES)).select(F.col("conv_id").alias("c")), "large")
    apart = F.col("conv_id").eqNullSafe(F.col("c"))
    some = not large.isEmpty()
    small = rows.join(large, apart, "left_anti") if some else rows
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    small = small.repartition("conv_id").sortWithinPartitions(*order)
    out = small.mapInArrow(partial(_small, arrow, turns), f"conv_id {name}, {last}")
    if some:
        big = rows.join(large, apart, "left_semi")
        out = out.unionByName(_large(big, arrow, name, turns, f"conv_id {name}, {last}"))
    return out
