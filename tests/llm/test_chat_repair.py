"""Conversation repair against an exhaustive search over edits, in chunks of any size."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sigloom.llm import chat_repair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, fault int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(":".join(shown).encode()) % 20
        if case:
            row = (conv, turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
            out += [row] * (2 if case == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired lines) by trying every edit at every place."""
    @functools.cache
    def best(i, so_far, inserts):
        found = []
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", so_far):
            found.append((0, "", ()))
        if inserts < 3:
            found += [(c + 5, "I" + a, (f"{r}:",) + t) for r in ("user", "assistant")
                      if re.fullmatch("s?(ua)*u?", so_far + r[0]) and (rest := best(i, so_far + r[0], inserts + 1)) for c, a, t in [rest]]
        if i < len(turns):
            role, text, fault = turns[i]
            if rest := best(i + 1, so_far, 0):
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            extra = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                for r, cost, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                    if r[:1] and re.fullmatch("s?(ua)*u?", so_far + r[0]) and (rest := best(i + 1, so_far + r[0], 0)):
                        found.append((rest[0] + cost + extra, letter + rest[1], (f"{r}:{text}",) + rest[2]))
        return min(found, default=None)
    return best(0, "", 0)


def shorter(turns):
    """The same with the state of the grammar for the roles so far, for longer conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {s: c for s, c in [("", (0, "", ())), ("s", (10, "II", ("user:", "assistant:"))), ("u", (5, "I", ("assistant:",))), ("a", (0, "", ()))]}
    for role, text, fault in reversed(turns):
        direct = {}
        for s in ("", "s", "u", "a"):
            options = [(after[s][0] + 2, "D" + after[s][1], after[s][2])]
            extra = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                for r, cost, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                    if (s, r[:1]) in step:
                        c, a, t = after[step[s, r[0]]]
                        options.append((c + cost + extra, letter + a, (f"{r}:{text}",) + t))
            direct[s] = min(options)
        before = dict(direct)
        for _ in range(2):
            for s in before:
                r = "assistant" if s == "u" else "user"
                c, a, t = before[step[s, r[0]]]
                before[s] = min(before[s], (c + 5, "I" + a, (f"{r}:",) + t))
        after = before
    return after[""]


def brute(rows, ids, search=shorter):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for conv in ids:
        mine = sorted(groups.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns, count = set(), [], collections.Counter()
        for _, _, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            turns.append((role, text, fault))
        at = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = search(tuple(turns))
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, count["blank"], count["duplicate"], count["truncated"], illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, longest, texts=("a.", "b!", "c?", "no end", " ", "", "x. \n", "é.", None)):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rnd.randint(1, longest)):
            text = rnd.choice(texts)
            text = text and text + str(rnd.randrange(30)) + rnd.choice([".", "!", "", ".", "."])
            rows.append((conv, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unicorn"]), text))
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 1), (3, 3)])
def test_report(spark, seed, chunk):
    rows = made(seed, 40, 14) + [(500, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(120)]
    rows += [(501, 0, "user", "same.")] * 40 + [(502, None, "user", "x" * 100000 + "."), (502, None, "user", "x" * 100000 + "!")]
    got = chat_repair.report(frame(spark, rows), frame(spark, rows + [(900, 1, "user", "gone")]), chunk).collect()
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(clean, {r[0] for r in rows} | {900})
    assert sorted(map(tuple, got), key=str) == want
    assert (900, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want


@pytest.mark.parametrize("seed", range(3))
def test_lattice_against_every_edit(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        turns = tuple((rnd.choice(["user", "assistant", "system", "tool", ""]), f"{i}", rnd.choice(["", "", "blank", "duplicate", "truncated"])) for i in range(rnd.randint(0, 6)))
        want = cheapest(turns)
        assert shorter(turns) == want
        initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r in (t[0] or "x" for t in turns))
        faults = "".join({"": "."}.get(t[2], t[2][:1]) for t in turns)
        lattice = [*chat_repair._lattice(initials, faults), chat_repair.TAIL]
        prices = chat_repair.auction(lattice, [0, chat_repair.FAR, chat_repair.FAR, 0])
        assert prices[0][0] == want[0]
        assert chat_repair.trace(lattice, prices, 0)[0].translate(str.maketrans("UAua", "RRII")) == want[1]


def test_damaged_table(spark):
    rows = made(7, 60, 8) + [(None, None, None, None)]
    df = frame(spark, rows)
    got = chat_repair.report(chat_repair.damage(df), df).collect()
    assert sorted(map(tuple, got), key=str) == brute(damaged(rows), {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Late."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"), (1, 3, "tool", "Answer."), (2, 0, "user", "Alone."), (3, 0, "system", " ")]
    got = sorted(map(tuple, chat_repair.repaired(frame(spark, rows), 2).collect()))
    want = []
    for conv in (1, 2, 3):
        _, _, lines = shorter(tuple((r, t, f) for (c, _, r, t), f in zip(rows, ["", "", "duplicate", "", "", "blank"]) if c == conv))
        want += [(conv, i, *line.split(":", 1)) for i, line in enumerate(lines)]
    assert got == want
    again = chat_repair.report(spark.createDataFrame(got, "conv_id long, turn long, role string, text string").where("text <> ''"), frame(spark, []))
    assert all(r.illegal == 0 for r in again.collect() if r.conv_id == 1)


def test_empty_table(spark):
    df = frame(spark, [])
    assert chat_repair.report(chat_repair.damage(df), df).collect() == [] and chat_repair.repaired(df).collect() == []


def test_long_conversation_is_spread(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(3000)] + [(2, None, "user", "again.")] * 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        turns = chat_repair.ordered(frame(spark, rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    most = turns.groupBy(F.shiftright("pos", 33)).count().agg(F.max("count"), F.count("*")).first()
    assert most[1] > 1 and most[0] < 2500
    got = chat_repair.report(frame(spark, rows), frame(spark, rows[:1]), 64).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, {1, 2})
