"""Repair of conversation structure: turns aligned with the grammar ``(system? (user assistant)+)?`` at least cost.

Alignment is Wagner and Fischer's, against the alternating string of each feasible length; all lengths of one string are columns
of one table, cells beyond the cost of a known repair are not computed (Ukkonen's band), and equal costs are settled by
comparing the backtraced audits.  Turns are aligned in blocks for each role in which a block may begin and end; the blocks'
results are joined in order, so that the work grows with the number of turns and not with its square.

Rows are dealt by ranges of (conversation, turn).  A conversation within one range is finished there.  Of one that reaches over
an edge, each range passes on slim codes and packed texts; only those meet again, first as a row for each range.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tracelens.session import materialise

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated turn that stays. Fixed values.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
NAMES = {"u": "user", "a": "assistant"}
_LAWFUL = {"su", "ua", "au"}
#: Turns aligned at a time, turns and characters of one packed piece of text, and characters of a text that the ranges look at.
BLOCK, PIECE_TURNS, PIECE_CHARS, RANGE_CHARS = 32, 256, 1 << 20, 64
_BLANKS = " \t\n\v\f\r"

#: A turn in code: its initial if that is s, u or a, else o; a capital if it is truncated; x if it must go.
Best = dict[tuple[str, str], tuple[int, str]]
Damage = Callable[[int | None, int | None, str | None, str | None], tuple[str, str, int]]


def damaged(conv_id: int | None, turn: int | None, role: str | None, text: str | None) -> tuple[str, str, int]:
    """(role, text, copies) of a row after its damage; no copy is left of a dropped one. Nulls are one blank."""
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
    if kind == 1:
        text = ""
    elif kind == 2:
        text = text.translate({ord(c): None for c in ".!?"})
    elif kind == 4:
        role = "user"
    return role, text, {0: 0, 3: 2}.get(kind, 1)


def as_it_is(conv_id: int | None, turn: int | None, role: str | None, text: str | None) -> tuple[str, str, int]:
    """No damage: (role, text, copies)."""
    return " " if role is None else role, " " if text is None else text, 1


def code(role: str, text: str) -> str:
    """The code of a turn that nothing has duplicated."""
    solid = text.rstrip(_BLANKS)
    if not solid:
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if solid[-1] in ".!?" else initial.upper()


def _alternating(first: str, length: int) -> str:
    """s?uaua... or auau... of the given length."""
    body = "ua" * (length // 2 + 1)
    return ("s" + body)[:length] if first == "s" else body[first == "a" :][:length]


#: A repair that ends in one role can go on as one that ends in any other for so much more (an insertion, and an s deleted).
ELSEWHERE = COST[INSERT] + COST[DELETE]


def _align(turns: str, first: str) -> dict[int, tuple[int, str]]:
    """Length of the alternating string -> (cost, least audit) of turning ``turns`` into it, for lengths that can be of use."""
    n = len(turns)
    stay = lambda c, goal: TRUNCATED * c.isupper() + (0 if c.lower() == goal else COST[REROLE] if goal in NAMES else 10**6)
    # a known repair: every turn stays, but for those before the first s where s must come first; dearer cells help nowhere
    skip = turns.lower().find("s") if first == "s" else 0
    if skip < 0:
        return {}
    known = COST[DELETE] * skip + sum(stay(c, g) for c, g in zip(turns[skip:], _alternating(first, n - skip), strict=True)) + ELSEWHERE
    goal = _alternating(first, n + known // COST[INSERT])
    above: dict[int, tuple[int, str]] = {0: (0, "")}
    while first != "s" and COST[INSERT] * len(above) <= known:
        above[len(above)] = COST[INSERT] * len(above), INSERT * len(above)
    for c in turns:
        row: dict[int, tuple[int, str]] = {}
        low, high = min(above, default=0), max(above, default=-1)
        for j in range(low, len(goal) + 1):
            options = []
            if j in above:
                options.append((above[j][0] + COST[DELETE], above[j][1] + DELETE))
            if j - 1 in above:
                same = c.lower() == goal[j - 1]
                options.append((above[j - 1][0] + stay(c, goal[j - 1]), above[j - 1][1] + (KEEP if same else REROLE)))
            if j - 1 in row and goal[j - 1] != "s":
                options.append((row[j - 1][0] + COST[INSERT], row[j - 1][1] + INSERT))
            if options and (best := min(options))[0] <= known:
                row[j] = best
            elif j > high:
                break
        above = row
    return above


@lru_cache(maxsize=20_000)
def _live_block(turns: str) -> Best:
    """(state before, state after) -> best repair of turns none of which must go. States: 0 nothing yet, s, u, a: the last role."""
    out: Best = {}

    def offer(before: str, after: str, found: tuple[int, str]) -> None:
        if (before, after) not in out or found < out[before, after]:
            out[before, after] = found

    for first, starts in (("u", "0sa"), ("a", "u"), ("s", "0")):
        for length, found in _align(turns, first).items():
            if first == "s" and not length:
                continue  # the same as with u
            for before in starts:
                offer(before, _alternating(first, length)[-1] if length else before, found)
    return out


def block(turns: str) -> Best:
    """As ``_live_block`` for turns of which some must go: each D comes before any insertion at its place."""
    gone = [len(x) for x in re.split("[^x]", turns)]
    out = {}
    for ends, (cost, audit) in _live_block(turns.replace("x", "")).items():
        parts, at = [DELETE * gone[0]], 0
        for edit in audit:
            parts.append(edit)
            if edit != INSERT:
                at += 1
                parts.append(DELETE * gone[at])
        out[ends] = cost + COST[DELETE] * sum(gone), "".join(parts)
    return out


def joined(blocks: list[Best]) -> Best:
    """The best repairs of consecutive blocks as one, pair by pair, so that long audits are copied few times."""
    while len(blocks) > 1:
        pairs = []
        for left, right in zip(blocks[::2], blocks[1::2], strict=False):
            both: Best = {}
            for (a, b), (cost, audit) in left.items():
                for (c, d), (cost2, audit2) in right.items():
                    if b == c and ((a, d) not in both or (cost + cost2, audit + audit2) < both[a, d]):
                        both[a, d] = cost + cost2, audit + audit2
            pairs.append(both)
        blocks = pairs + blocks[len(blocks) - len(blocks) % 2 :]
    return blocks[0] if blocks else {(s, s): (0, "") for s in "0sua"}


def repairs(turns: str) -> Best:
    """Best repairs of coded turns for every state before and after them."""
    return joined([block(turns[k : k + BLOCK]) for k in range(0, len(turns), BLOCK)])


def whole_repair(best: Best) -> tuple[int, str]:
    """(cost, audit) that begins with nothing and ends in the grammar."""
    ended = joined([best, {("0", "0"): (0, ""), ("a", "a"): (0, ""), ("u", "a"): (COST[INSERT], INSERT), ("s", "a"): (2 * COST[INSERT], INSERT * 2), ("0", "a"): (2 * COST[INSERT], INSERT * 2)}])
    return min(v for (a, b), v in ended.items() if a == "0" and b in "0a")


class Repaired:
    """The lines ``role:text`` that audits leave of consecutive turns; remembers the last role in between."""

    def __init__(self) -> None:
        self.state = "0"

    def lines(self, turns: list[tuple[str, str, int]], audit: str) -> Iterator[str]:
        """Lines of (role, text, copies) under their part of the audit."""
        rows = ((role, text) for role, text, copies in turns for _ in range(copies))
        for edit in audit:
            role, text = ("", "") if edit == INSERT else next(rows)
            if edit == DELETE:
                continue
            if edit == KEEP:
                self.state = role[0]
            else:
                self.state = "a" if self.state == "u" else "u"
                role = NAMES[self.state]
            yield f"{role}:{text}"


class Facts:
    """Turns and adjacent roles of consecutive rows of one conversation."""

    FIELDS = ("low", "high", "turns", "illegal", "first", "last")

    def __init__(self, values: dict | None = None) -> None:
        self.low = self.high = self.first = self.last = None
        self.turns = self.illegal = 0
        self.__dict__.update(values or {})

    def add(self, turn: int | None, role: str, copies: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += copies - 1  # no role may follow itself
        self._meet(role[:1])
        self.last = role[:1]

    def _meet(self, initial: str) -> None:
        self.illegal += self.last is not None and self.last + initial not in _LAWFUL
        self.first = initial if self.first is None else self.first

    def follow(self, other: Facts) -> None:
        """Take in the facts of what comes next."""
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        self.illegal += other.illegal
        if other.first is not None:
            self._meet(other.first)
            self.last = other.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
_FACTS = pa.struct([(f, _TEXT if f in ("first", "last") else _LONG) for f in Facts.FIELDS])
_FAULTS = [(c, _LONG) for c in ("blank", "duplicate", "truncated")]
_RESULT = [("conv_id", _LONG), *((c, _LONG) for c in COUNTS), ("audit", _TEXT), ("repaired_sha256", _TEXT)]
_ROWS = pa.schema([("conv_id", _LONG), ("turn", _LONG), ("role", _TEXT), ("text", _TEXT), ("copies", _INT)])
_SLIM = [("sizes", pa.list_(_INT)), ("facts", _FACTS)]
_PASSED = pa.schema([
    ("kind", _TEXT), ("part", _INT), ("edge", _INT), ("piece", _INT), *_RESULT, *_SLIM, ("codes", _TEXT), ("copies", pa.list_(_INT)),
    ("keys", pa.list_(pa.binary())), ("rows", pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT), ("copies", _INT)]))),
])
_ENDS = pa.list_(pa.struct([("before", _TEXT), ("after", _TEXT), ("cost", _LONG), ("audit", _TEXT)]))
_SOLVED = pa.schema([("conv_id", _LONG), ("part", _INT), ("edge", _INT), *_SLIM, *_FAULTS, ("ends", _ENDS)])
_JOINED = pa.schema([*_RESULT, ("part", _INT), ("piece", _INT), ("edits", _TEXT)])
_HASHED = pa.schema([("conv_id", _LONG), ("repaired_sha256", _TEXT)])


class Turns:
    """The rows of one conversation inside one range, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.facts, self.rows = conv_id, Facts(), []
        self.codes: list[str] = []
        self.keys: list[bytes | None] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if not copies:
            return
        self.facts.add(turn, role, copies)
        self.rows.append((role, text, copies))
        found, key = code(role, text), None
        if found == "x":
            self.blank += copies
        else:
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            self.duplicate += copies - 1
            if key in self.seen:
                self.duplicate, found, key = self.duplicate + 1, "x", None
            else:
                self.seen.add(key)
                self.truncated += found.isupper()
        self.codes.append(found)
        self.keys.append(key)

    def result(self) -> dict:
        cost, audit = whole_repair(repairs(expanded(self.codes, [c for *_, c in self.rows])))
        text = "\n".join(Repaired().lines(self.rows, audit))
        return {
            "conv_id": self.conv_id, "gaps": self.facts.gaps(), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.facts.illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }

    def passed_on(self, part: int, edge: int) -> Iterator[dict]:
        """A slim row, and the texts in pieces."""
        place, low, sizes = {"conv_id": self.conv_id, "part": part, "edge": edge}, 0, []
        while low < len(self.rows):
            high, chars = low, 0
            while high < len(self.rows) and high - low < PIECE_TURNS and (high == low or chars + len(self.rows[high][1]) <= PIECE_CHARS):
                chars += len(self.rows[high][1])
                high += 1
            some = self.rows[low:high]
            yield place | {"kind": "text", "piece": len(sizes), "rows": [{"role": r, "text": t, "copies": c} for r, t, c in some]}
            sizes.append(sum(c for *_, c in some))
            low = high
        yield place | {
            "kind": "range", "codes": "".join(self.codes), "copies": [c for *_, c in self.rows], "keys": self.keys, "sizes": sizes,
            "facts": {f: getattr(self.facts, f) for f in Facts.FIELDS}, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
        }


def expanded(codes: list[str] | str, copies: list[int]) -> str:
    """One code for each copy; copies after the first must go."""
    return "".join(c if n == 1 else c + "x" * (n - 1) for c, n in zip(codes, copies, strict=True))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1_000, chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of dicts, ended after ``most`` rows or some texts of ``chars`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(r["text"]) for r in row.get("rows") or ()) + len(row.get("audit") or "")
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _prepared(batches: Iterator[pa.RecordBatch], damage: Damage) -> Iterator[pa.RecordBatch]:
    """Rows after damage, equal ones of a batch as one with its copies; of a dropped one the ids stay, with no copy."""
    for batch in batches:
        copies: dict[tuple, int] = {}
        for conv_id, turn, role, text in _columns(batch, "conv_id", "turn", "role", "text"):
            role, text, n = damage(conv_id, turn, role, text)
            key = (conv_id, turn, role, text) if n else (conv_id, turn, None, None)
            copies[key] = copies.get(key, 0) + n
        yield from _batches(({"conv_id": k[0], "turn": k[1], "role": k[2], "text": k[3], "copies": n} for k, n in copies.items()), _ROWS, len(copies) + 1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside this range; the first and the last may reach over its edges and are passed on."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        now, first = None, True
        for batch in batches:
            for conv_id, turn, role, text, copies in _columns(batch, "conv_id", "turn", "role", "text", "copies"):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from now.passed_on(part, 0) if first else [{"kind": "whole"} | now.result()]
                        first = False
                    now = Turns(conv_id)
                now.add(turn, role, text, copies)
        if now is not None:
            yield from now.passed_on(part, 0 if first else 1)

    yield from _batches(rows(), _PASSED)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best repairs of each range's turns for every role before and after them; ``late``: turns that an earlier range has."""

    def rows() -> Iterator[dict]:
        names = ("conv_id", "part", "edge", "sizes", "blank", "duplicate", "truncated", "facts", "codes", "copies", "late")
        for batch in batches:
            for values in _columns(batch, *names):
                row = dict(zip(names, values, strict=True))
                codes = list(row.pop("codes"))
                for at in row.pop("late") or ():
                    row["duplicate"], row["truncated"], codes[at] = row["duplicate"] + 1, row["truncated"] - codes[at].isupper(), "x"
                best = repairs(expanded(codes, row.pop("copies")))
                yield row | {"ends": [{"before": a, "after": b, "cost": c, "audit": e} for (a, b), (c, e) in best.items()]}

    yield from _batches(rows(), _SOLVED, 100)


def _joined_up(ranges: pa.Table) -> pa.Table:
    """The result row of one conversation (part is null), and the edits of each piece of its text."""
    rows = sorted(ranges.to_pylist(), key=lambda r: r["part"])
    facts = Facts()
    for r in rows:
        facts.follow(Facts(r["facts"]))
    cost, audit = whole_repair(joined([{(e["before"], e["after"]): (e["cost"], e["audit"]) for e in r["ends"]} for r in rows]))
    sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}
    out = [{"conv_id": rows[0]["conv_id"], "gaps": facts.gaps(), **sums, "illegal": facts.illegal, "cost": cost, "audit": audit}]
    ends = [m.end() for m in re.finditer(f"{INSERT}*[^{INSERT}]", audit)]  # after each turn's edit
    taken, low = 0, 0
    places = [(r["part"], k, n) for r in rows for k, n in enumerate(r["sizes"])]
    for k, (part, piece, n) in enumerate(places):
        taken += n
        high = len(audit) if k + 1 == len(places) else ends[taken - 1]
        out.append({"conv_id": rows[0]["conv_id"], "part": part, "piece": piece, "edits": audit[low:high]})
        low = high
    return pa.Table.from_pylist(out, _JOINED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of conversations whose edits and pieces come in order; one piece is held at a time."""

    def rows() -> Iterator[dict]:
        now, digest = (), None
        for batch in batches:
            for conv_id, edits, turns in _columns(batch, "conv_id", "edits", "rows"):
                if now != (conv_id,):
                    if now:
                        yield {"conv_id": now[0], "repaired_sha256": digest.hexdigest()}
                    now, digest, repaired, gap, audit = (conv_id,), hashlib.sha256(), Repaired(), "", ""
                if turns is None:
                    audit = edits
                    continue
                for line in repaired.lines([(t["role"], t["text"], t["copies"]) for t in turns], audit):
                    digest.update(f"{gap}{line}".encode())
                    gap = "\n"
        if now:
            yield {"conv_id": now[0], "repaired_sha256": digest.hexdigest()}

    yield from _batches(rows(), _HASHED)


def repair_conversations(conversations: DataFrame, damage: Damage = as_it_is) -> DataFrame:
    """One row for each conv_id: gaps in the turns, first faults by kind, illegal neighbours, and the cheapest repair.

    ``damage`` maps (conv_id, turn, role, text) to (role, text, copies).  Turns go in order of turn (null first), then role and
    text; null roles and texts are one blank; a null conv_id is a conversation; repeated rows are duplicates; a conversation
    of which damage leaves nothing has zeros, an empty audit and the hash of nothing; an empty table gives no rows; columns
    other than the four are not read.  The hash of a conversation runs through its text in order, so that one task streams it, a piece at a time;
    ``audit`` is as long as the conversation has turns.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ready = rows.mapInArrow(lambda b: _prepared(b, damage), from_arrow_schema(_ROWS))
    dealt = ready.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("conv_id", "turn", "role", "text")
    passed = materialise(dealt.mapInArrow(_ranges, from_arrow_schema(_PASSED)))
    result = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    ranges = passed.filter("kind = 'range'")
    # a turn that an earlier range of its conversation has: ranges hold each key once, so a group has a row for each range at most
    place = F.struct("part", "edge", "pos")
    keyed = ranges.select("conv_id", "part", "edge", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
    again = keyed.groupBy("conv_id", "key").agg(F.array_sort(F.collect_list(place)).alias("at")).filter(F.size("at") > 1)
    late = again.select(F.explode(F.slice("at", 2, F.size("at") - 1)).alias("p")).groupBy("p.part", "p.edge").agg(F.collect_list("p.pos").alias("late"))
    slim = ranges.select("conv_id", "part", "edge", "sizes", "blank", "duplicate", "truncated", "facts", "codes", "copies")
    solved = slim.join(late, ["part", "edge"], "left").mapInArrow(_solved, from_arrow_schema(_SOLVED))
    joined_up = materialise(solved.groupBy("conv_id").applyInArrow(_joined_up, from_arrow_schema(_JOINED)))
    edits = joined_up.filter("part is not null").select("conv_id", "part", "piece", "edits")
    texts = passed.filter("kind = 'text'").select("conv_id", "part", "piece", "rows")
    stream = edits.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", F.col("rows").isNotNull())
    hashes = stream.mapInArrow(_hashed, from_arrow_schema(_HASHED))
    figures = joined_up.filter("part is null").select("conv_id", *COUNTS, "audit")
    told = figures.alias("f").join(hashes.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    over = told.select("f.*", F.coalesce("h.repaired_sha256", nothing).alias("repaired_sha256"))
    return passed.filter("kind = 'whole'").select(*result).unionByName(over)
