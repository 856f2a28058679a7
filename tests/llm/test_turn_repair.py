"""Conversation repair against a search that keeps whole audit strings, in memory and across partitions."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from landpulse.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit) least by cost, then by the string: every edit of every turn in every state, insertions included."""

    @cache
    def rest(k, expects, inserted):
        # expects: "" start, "U" after s, "a" after u, "u" after a
        found = []
        if k == len(turns) and expects in ("", "u"):
            found.append((0, ""))
        follows = "u" if expects == "a" else "a"
        if inserted < 3:
            cost, audit = rest(k, follows, inserted + 1)
            found.append((cost + 5, "I" + audit))
        if k < len(turns):
            role, fault = turns[k]
            cost, audit = rest(k + 1, expects, 0)
            found.append((cost + 2, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                cost, audit = rest(k + 1, follows, 0)
                found.append((cost + 1 + more, "R" + audit))
                if role[:1] == ("a" if expects == "a" else "u"):
                    found.append((cost + more, "K" + audit))
                if role[:1] == "s" and expects == "":
                    cost, audit = rest(k + 1, "U", 0)
                    found.append((cost + more, "K" + audit))
        return min(found, default=(10**9, ""))

    for k in range(len(turns), 0, -1):  # from the end, so that no call goes deep
        for expects in ("", "U", "a", "u"):
            rest(k, expects, 0)
    return rest(0, "", 0)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in turns:
            end = text.strip(WHITE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [r[1] for r in turns if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(tuple((r[2], f) for r, f in zip(turns, faults)))
        lines, at, users = [], 0, True
        for letter in audit:
            if letter == "I":
                lines.append("user:" if users else "assistant:")
                users = not users
                continue
            role, text = turns[at][2:]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "user" if users else "assistant"
            users = not users if role[:1] != "s" or letter == "R" else users
            lines.append(f"{role}:{text}")
        out[conv] = (conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def drawn(seed, conversations, longest):
    draw = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "supervisor"], ["Yes.", "No", "Why?", " \n", "", None, "é!", "a. \t", " ", "x\u0085"]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, turn + 5, 2, None]), role, draw.choice(texts) if draw.random() < 0.5 else f"text {turn}."))
    return rows


def check(spark, rows, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = turn_repair.summaries(turn_repair.damage(spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)))).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = expected(rows)
    assert len(found) == len(want)
    for row in found:
        assert tuple(row) == want[row["conv_id"]]


@pytest.mark.parametrize("parts", [1, 7])
def test_summaries_agree_with_search_over_audit_strings(spark, parts):
    check(spark, drawn(parts, 120, 9), parts)


def test_one_conversation_over_all_partitions(spark):
    rows = drawn(5, 3, 4) + [(77, k // 2, ("user", "assistant", "system")[k % 7 % 3], f"row {k % 50}" + ".?"[k % 3:]) for k in range(600)] + [(78, 1, "user", "Same.")] * 90
    check(spark, rows, 6)


def test_blocks_do_not_change_the_walk():
    draw = random.Random(2)
    for size in (1, 2, 5, 1000):
        for _ in range(40):
            turns = [(draw.choice(["system", "user", "assistant", "x"]), str(k), draw.randint(0, 3)) for k in range(draw.randint(0, 30))]
            costs = [turn_repair.END]
            for role, _, fault in reversed(turns):
                costs.append(turn_repair.back(costs[-1], turn_repair.initial_of(role), fault))
            costs.reverse()
            letters = []
            walk = turn_repair.Walk(lambda letter, role, text: letters.append(letter))
            for low in range(0, len(turns), size):
                walk.block(turns[low:low + size], costs[min(low + size, len(turns))])
            walk.end()
            names = ("", "blank", "duplicate", "truncated")
            assert (walk.cost, "".join(letters)) == cheapest(tuple((role, names[fault]) for role, _, fault in turns))


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 2, "user", "Hi."), (1, 3, "user", "Again."), (1, 5, "assistant", "Yes"), (2, 1, "assistant", None)]
    frame = spark.createDataFrame([(c, False, t, r, x or "") for c, t, r, x in rows], turn_repair.ROW)
    got = [tuple(r) for r in turn_repair.repaired_turns(frame).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again."), (1, 2, "D", "assistant", "Yes"), (2, 0, "D", "assistant", "")]
    assert turn_repair.summaries(turn_repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []
