"""Conversation structure repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mektup.llm import repair

KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
CHOSEN = (2, 2, 3, 2)
NONE = (10**9, "")


def cheapest(rows):
    """(cost, audit) for rows of (initial, fault), by the least pair from the end."""
    after = None
    for k in range(len(rows), -1, -1):
        now = []
        for q in range(4):
            ways = [NONE]
            if k == len(rows):
                ways += [(0, "")] if q in (0, 3) else []
            else:
                initial, fault = rows[k]
                ways.append((2 + after[q][0], "D" + after[q][1]))
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    if (q, initial) in KEPT:
                        then = after[KEPT[q, initial]]
                        ways.append((extra + then[0], "K" + then[1]))
                    then = after[CHOSEN[q]]
                    ways.append((1 + extra + then[0], "R" + then[1]))
            now.append(min(ways))
        for _ in range(3):
            now = [min(now[q], (now[CHOSEN[q]][0] + 5, "I" + now[CHOSEN[q]][1])) for q in range(4)]
        after = now
    return after[0]


def plain(turns):
    conversations = defaultdict(list)
    for conv, turn, role, text in turns:
        conversations[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    found = []
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: r[:4])
        seen, marked = set(), []
        for _, _, role, text, _ in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = cheapest(marked)
        numbers = [r[4] for r in rows if r[4] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        total = sum(c != "D" for c in audit)
        out, row, k = [], 0, 0
        for c in audit:
            if c != "D":
                k += 1
                chosen = "user" if (k - total % 2) % 2 == 1 else "assistant"
                out.append((c, rows[row][2] if c == "K" else chosen, "" if c == "I" else rows[row][3]))
            row += c != "I"
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        counts = [sum(m[1] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
        found.append(((conv, gaps, *counts, illegal, cost, audit, digest), out))
    return found


def some_turns(seed, conversations, longest):
    chance = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "So?", "not ended", " \t\n", "", None, "Ends here!  ", "ünïcode 日本。", "x."]
    turns = []
    for conv in range(conversations):
        for turn in range(chance.randrange(1, longest)):
            turns.append((conv, chance.choice([turn, turn, turn, turn + 3, None]), chance.choice(roles), chance.choice(texts) if chance.random() < 0.5 else f"Turn {turn}."))
    return turns


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_give_the_plain_programme(block):
    chance = random.Random(block)
    kinds = [("s", None), ("u", None), ("a", None), ("x", None), ("s", "truncated"), ("u", "truncated"), ("a", "truncated"), ("x", "truncated"), ("u", "blank")]
    for _ in range(300):
        numbers = [chance.randrange(9) for _ in range(chance.randrange(12))]
        n = len(numbers)
        rows = repair.Rows([0] * n, ["user"] * n, ["x"] * n, numbers, [False] * n)
        told, _, _ = rows.edited(repair.tables(block).number[repair.END], 0, block, True)
        assert (told.cost, "".join(told.audit)) == cheapest([kinds[k] for k in numbers])


@pytest.mark.parametrize("limits", [repair.Limits(), repair.Limits(rows=3), repair.Limits(rows=5, chars=9, block=2)])
def test_like_the_plain_version(spark, limits):
    turns = some_turns(1, 40, 12) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (7, 1, "user", "Hi.")] * 2
    # a conversation that holds a third of all rows, and one that repeats a single row
    turns += [(500, t, ("user", "assistant")[t % 2], f"Long {t // 3}.") for t in range(120)] + [(501, 4, "user", "Again.")] * 40
    chance = random.Random(2)
    chance.shuffle(turns)
    expected = plain(turns)
    rows = spark.createDataFrame(turns, SCHEMA)
    found = [tuple(r) for r in repair.repair(rows, limits).collect()]
    assert sorted(found, key=str) == sorted([s for s, _ in expected], key=str)
    held = defaultdict(list)
    for r in repair.mended(rows, limits).orderBy("conv_id", "place").collect():
        held[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert held == {s[0]: out for s, out in expected if out}


def test_rows_that_are_not_live_keep_their_conversation(spark):
    turns = [(1, 0, "user", "Hi.", False), (2, 0, "user", "Hi.", True), (2, 1, "assistant", "Yes.", False)]
    rows = spark.createDataFrame(turns, f"{SCHEMA}, live boolean").withColumn("cost", F.lit(3)).withColumn("part", F.lit(1))
    found = {r["conv_id"]: r.asDict() for r in repair.repair(rows).collect()}
    assert found[1]["audit"] == "" and found[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (found[1]["cost"], found[1]["gaps"], found[1]["illegal"]) == (0, 0, 0)
    assert (found[2]["audit"], found[2]["cost"]) == ("D", 2)


def test_very_long_text_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a" * 3_000_000 + "?"), (1, 1, "assistant", "b.")], SCHEMA)
    assert [r["audit"] for r in repair.repair(rows, repair.Limits(chars=1000)).collect()] == ["KK"]
    assert repair.repair(rows.limit(0)).count() == 0 and repair.mended(rows.limit(0)).count() == 0
