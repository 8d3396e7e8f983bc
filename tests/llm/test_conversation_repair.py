"""Conversation repair against an automaton that walks each conversation turn by turn."""

import collections
import hashlib
import random
import zlib

import pytest

from tracelens.llm import conversation_repair as cr
from tracelens.llm.conversation_repair import as_it_is, damaged, repair_conversations, repairs, whole_repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"


def best_walk(codes):
    """(cost, audit): every state's least cost and least audit after each turn, with insertions as steps between turns."""

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = "a" if s == "u" else "u"
                states[to] = min(states.get(to, (10**9, "")), (c + 5, a + "I"))
        return states

    states = inserted({"0": (0, "")})
    for c in codes:
        following = {}

        def offer(s, v):
            following[s] = min(following.get(s, (10**9, "")), v)

        for s, (cost, audit) in states.items():
            offer(s, (cost + 2, audit + "D"))
            if c == "x":
                continue
            wanted, late = "a" if s == "u" else "u", 5 * c.isupper()
            if s == "0" and c.lower() == "s":
                offer("s", (cost + late, audit + "K"))
            keep = c.lower() == wanted
            offer(wanted, (cost + late + (not keep), audit + ("K" if keep else "R")))
        states = inserted(following)
    return min(v for s, v in states.items() if s in "0a")


def brute(rows, damage):
    conversations = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        conversations[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, codes, seen = collections.Counter(), "", set()
        for _, role, text in own:
            solid = text.strip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            initial = role[0] if role and role[0] in "sua" else "o"
            codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, *_ in own if t is not None]
        cost, audit = best_walk(codes)
        lines, last, left = [], "", iter(own)
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, "", "")
            if edit in "RI":
                role = "user" if last != "u" else "assistant"
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [3, 5, 32])
def test_alignment_equals_the_walk(size, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", size)
    draw = random.Random(size)
    for _ in range(1500):
        codes = "".join(draw.choices(draw.choice(["suaoSUAOx", "uaUAx", "ssuax", "uuua", "uaSAo"]), k=draw.randint(0, 3 * size if size < 32 else 70)))
        assert whole_repair(repairs(codes)) == best_walk(codes), codes


def conversations(draw):
    texts = ["Yes.", "No!", "so", "", " \t\v", "Why?\n", "ends, ", "ü.", "long " * 40 + "end."]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    rows = []
    for conv in (*range(30), None):
        for turn in range(draw.randint(1, 12)):
            if draw.random() < 0.9:
                role = ["user", "assistant"][turn % 2] if draw.random() < 0.8 else draw.choice(roles)
                rows.append((conv, turn if draw.random() < 0.95 else None, role, draw.choice([*texts, None, f"text {turn}."])))
    rows += [(99, turn, ["user", "assistant"][turn % 2], draw.choice([*texts, f"at {turn}.", f"at {turn % 50}."])) for turn in range(3600)]
    rows += [(99, 7, "user", "the same row.")] * 300 + [(98, 0, "user", "  ")] * 40
    draw.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("damage", [damaged, as_it_is])
def test_table_over_many_ranges(spark, many_ranges, damage):
    rows = conversations(random.Random(4))
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(3)
    got = repair_conversations(df, damage)
    assert got.columns == ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    assert found(got) == brute(rows, damage is damaged)


def test_empty_table_and_conversation_that_goes(spark):
    assert found(repair_conversations(spark.createDataFrame([], SCHEMA), damaged)) == set()
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(5, turn, "user", "Hello.", None, None)], SCHEMA)
    assert found(repair_conversations(only, damaged)) == {(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_texts_in_pieces(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "word " * 50_000 + f"{t}.") for t in range(6)]
    assert found(repair_conversations(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))) == brute(rows, False)
