"""Repair of conversation structure by an auction shortest-path algorithm over the lattice of edits.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. A node of the lattice is a place
between turns and a state of that grammar; arcs are the edits: Keep 0, Rerole 1, Delete 2 (the only one for blank
and repeated turns), Insert 5, and 5 more for a truncated turn that is not deleted. The auction keeps a price for
every node, never above an arc's cost plus the price at its end. From an origin a path is extended along an arc
whose cost makes up the difference of prices exactly; where there is none, the price of the path's last node rises
to the best offer and the path contracts by one node. Origins are taken from the end of the lattice to its start,
so a path ends at the first node whose price has converged. In converged prices the cheapest repairs are just the
tight arcs; taking the least letter at each node from the start traces the least audit among them.

Conversations are ordered by ``turn`` (nulls first), role, the first 64 characters of the text and its hash, by a
range partitioning whose last key tells equal rows apart, so a conversation of any length is spread over tasks.
Chunks of at most ``CHUNK`` turns are priced for every way through them (state in, state out); a conversation's
chunk summaries form a lattice of the same kind, whose prices are handed back to the chunks for the trace. Only
these summaries (a few hundred bytes for ``CHUNK`` turns) and the audit itself are held for a whole conversation;
texts pass through in order, in one task for each conversation when its digest is taken, and are never collected.

Defined results: null roles and texts are one space (a blank text; a role that fits nowhere). An empty role has
no initial and cannot be kept. Rows of equal turn follow role and text; a repeated row is a duplicate. Null
``conv_id`` is one conversation; null turns come first and count in no gap. Equal MD5 hashes are taken as equal
texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

CHUNK = 4096
FAR = 1 << 60  # price of a node from which the end is out of reach

# Fixed values of the edit rules.
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # state after a role's initial; 0 and 3 may end
LEGAL = {"su", "ua", "au"}
BLANK, BREAK = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"

#: A lattice: for each layer and state the arcs ``(letter, step, cost, layers onward, state)``.
Arc = tuple[str, str, int, int, int]
Lattice = list[list[list[Arc]]]


def _new_role(state: int) -> str:
    return "a" if state == 2 else "u"


def _insert_arcs(state: int) -> list[Arc]:
    role = _new_role(state)
    return [("I", role, INSERT, 0, NEXT[state][role])]


@lru_cache(maxsize=None)
def _turn_arcs(initial: str, fault: str) -> list[list[Arc]]:
    """Arcs of one turn (after any inserts before it) for every state, in the order of their letters."""
    out = []
    for state in range(4):
        arcs: list[Arc] = [("D", "D", DELETE, 1, state), *_insert_arcs(state)]
        if fault not in "bd":
            extra = CUT if fault == "t" else 0
            if initial in NEXT[state]:
                arcs.append(("K", "K", extra, 1, NEXT[state][initial]))
            role = _new_role(state)
            arcs.append(("R", role.upper(), REROLE + extra, 1, NEXT[state][role]))
        out.append(arcs)
    return out


#: After the last turn: inserts up to a legal end (then the arc to the end itself).
TAIL: list[list[Arc]] = [([("", "", 0, 1, state)] if state in (0, 3) else []) + _insert_arcs(state) for state in range(4)]


def auction(lattice: Lattice, end: list[int]) -> list[list[int]]:
    """Converged prices of all nodes; ``end`` holds the prices behind the last layer (``FAR``: out of reach)."""
    prices: list[list[int]] = [[FAR] * 4 for _ in lattice] + [list(end)]
    for at in range(len(lattice) - 1, -1, -1):
        layer, here, onward = lattice[at], prices[at], prices[at + 1]
        # The end is out of reach from nodes without an arc to one that reaches it.
        reach = {s for s in range(4) if any(onward[t] < FAR for _, _, _, ahead, t in layer[s] if ahead)}
        grown = True
        while grown:
            more = {s for s in range(4) if any(not ahead and t in reach for _, _, _, ahead, t in layer[s])} - reach
            reach |= more
            grown = bool(more)
        start = min((p for p in onward if p < FAR), default=FAR)
        for s in reach:
            here[s] = start  # no arc is dearer than free, so the least price ahead is a fair first price
        done: set[int] = set()
        for origin in sorted(reach):
            path = [origin]
            while path[-1] not in done:
                s = path[-1]
                best, to, ahead = min((c + (onward if ahead else here)[t], t, ahead) for _, _, c, ahead, t in layer[s])
                if here[s] < best:
                    here[s] = best          # the price rises and the path contracts
                    if len(path) > 1:
                        path.pop()
                elif ahead:
                    break                   # the path reaches a converged layer
                else:
                    path.append(to)         # the path extends along a tight arc
            done.update(path)
    return prices


def trace(lattice: Lattice, prices: list[list[int]], state: int) -> tuple[str, int]:
    """Steps of the least audit along tight arcs from ``state``, and the state behind the last layer."""
    at, steps = 0, []
    while at < len(lattice):
        here = prices[at][state]
        _, step, _, ahead, state = min((a for a in lattice[at][state] if here == a[2] + prices[at + a[3]][a[4]]), key=lambda a: a[0])
        steps.append(step)
        at += ahead
    return "".join(steps), state


def _lattice(initials: str, faults: str) -> Lattice:
    return [_turn_arcs(i, f) for i, f in zip(initials, faults)]


@lru_cache(maxsize=4096)
def crossing(initials: str, faults: str) -> tuple[tuple[int, ...], ...]:
    """Least cost of a chunk for every state in (rows) and out (columns)."""
    lattice = _lattice(initials, faults)
    ways = [auction(lattice, [0 if t == out else FAR for t in range(4)])[0] for out in range(4)]
    return tuple(tuple(ways[out][s] for out in range(4)) for s in range(4))


@lru_cache(maxsize=4096)
def traces(initials: str, faults: str, end: tuple[int, ...]) -> list[tuple[str | None, int]]:
    """The traced steps and the state out for every state in, before the prices ``end``."""
    lattice = _lattice(initials, faults)
    prices = auction(lattice, list(end))
    return [trace(lattice, prices, s) if prices[0][s] < FAR else (None, 0) for s in range(4)]


def chain(crossings: Iterable[tuple]) -> list[list[int]]:
    """Prices before each chunk of a conversation and before its tail."""
    lattice: Lattice = [[[("", "", c, 1, t) for t, c in enumerate(row) if c < FAR] for row in m] for m in crossings]
    return auction([*lattice, TAIL], [0, FAR, FAR, 0])[:-1]


# ------------------------------------------------------------------ tasks
_LONG4 = pa.list_(pa.int64())


def _summaries(batches):
    schema = pa.schema([("m", _LONG4), ("illegal", pa.int64())])
    for batch in batches:
        ms, wrong = [], []
        for initials, faults in zip(batch["initials"].to_pylist(), batch["faults"].to_pylist()):
            ms.append([c for row in crossing(initials, faults) for c in row])
            wrong.append(sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ms, _LONG4), pa.array(wrong, pa.int64())],
                                         schema=pa.schema([*batch.schema, *schema]))


def _chained(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("end", _LONG4), ("cost", pa.int64()), ("illegal", pa.int64())])
    for batch in batches:
        rows = []
        for conv, parts in zip(batch["conv_id"].to_pylist(), batch["parts"].to_pylist()):
            prices = chain([[p["m"][4 * s:4 * s + 4] for s in range(4)] for p in parts])
            wrong = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
            for i, p in enumerate(parts):
                least = min(prices[i + 1])
                rows.append({"conv_id": conv, "chunk": p["chunk"], "end": [c if c >= FAR else c - least for c in prices[i + 1]],
                             "cost": prices[0][0] if i == 0 else None, "illegal": wrong if i == 0 else None})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _traced(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("begin", pa.int64()), ("steps", pa.list_(pa.string())),
                        ("outs", pa.list_(pa.int32())), ("cost", pa.int64()), ("illegal", pa.int64())])
    for batch in batches:
        found = [traces(i, f, tuple(e)) for i, f, e in zip(*(batch[c].to_pylist() for c in ("initials", "faults", "end")))]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["chunk"], batch["begin"], pa.array([[s for s, _ in f] for f in found], pa.list_(pa.string())),
                                          pa.array([[o for _, o in f] for f in found], pa.list_(pa.int32())), batch["cost"], batch["illegal"]], schema=schema)


_TAIL_STEPS = {0: "", 1: "ua", 2: "a", 3: ""}  # what TAIL's cheapest path inserts
_PICKED = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()),
                     ("picked", pa.list_(pa.struct([("begin", pa.int64()), ("steps", pa.string())])))])


def _picked(batches):
    letters = str.maketrans("UAua", "RRII")
    for batch in batches:
        rows = []
        for conv, parts in zip(batch["conv_id"].to_pylist(), batch["parts"].to_pylist()):
            state, picked = 0, []
            for p in parts:
                picked.append({"begin": p["begin"], "steps": p["steps"][state]})
                state = p["outs"][state]
            picked[-1]["steps"] += _TAIL_STEPS[state]
            rows.append({"conv_id": conv, "cost": parts[0]["cost"], "illegal": parts[0]["illegal"],
                         "audit": "".join(p["steps"] for p in picked).translate(letters), "picked": picked})
        yield pa.RecordBatch.from_pylist(rows, schema=_PICKED)


def _edit_rows(batches):
    """Kept, reroled and inserted turns as ``(conv_id, pos, sub, role)``; a null role is the turn's own."""
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("sub", pa.int32()), ("role", pa.string())])
    names = {"K": None, "U": "user", "A": "assistant", "u": "user", "a": "assistant"}
    for batch in batches:
        rows = []
        for conv, begin, steps in zip(*(batch[c].to_pylist() for c in ("conv_id", "begin", "steps"))):
            pos, sub = begin, 0
            for step in steps:
                if step in "ua":
                    rows.append({"conv_id": conv, "pos": pos, "sub": sub, "role": names[step]})
                    sub += 1
                else:
                    if step != "D":
                        rows.append({"conv_id": conv, "pos": pos, "sub": OWN, "role": names[step]})
                    pos, sub = pos + 1, 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


# ------------------------------------------------------------------ the operator
OWN = 1 << 20  # place of a turn after the inserts before it


def ordered(rows: DataFrame) -> DataFrame:
    """Turns in order: ``conv_id, pos, turn, role, text, hash``; a stored table."""
    space = F.lit(" ")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    turns = turns.select("*", F.md5("text").alias("hash"), F.left(F.col("text"), F.lit(64)).alias("front"), F.monotonically_increasing_id().alias("salt"))
    keys = ["conv_id", "turn", "role", "front", "hash", "salt"]
    placed = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return store(placed.select("conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "hash"))


def judged(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, initial, fault``: b(lank), d(uplicate), t(runcated) or a dot."""
    first = turns.groupBy("conv_id", "role", "hash").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(BLANK)
    cut = ~F.regexp_extract("text", BREAK, 1).isin(".", "!", "?")
    own = turns.select("conv_id", "pos", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), blank.alias("blank"), cut.alias("cut"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise(".")
    return own.join(first, "pos", "left").select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the judged turns and of ``conv_id, cost, illegal, audit, picked``, for a table of ``ordered``."""
    marks = store(judged(turns))
    lines = marks.withColumn("chunk", F.floor(F.col("pos") / chunk)).groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", "fault"))).alias("t"))  # at most ``chunk`` turns
    text = lambda part: F.array_join(F.transform("t", lambda x: x[part]), "")
    lines = lines.select("conv_id", "chunk", F.col("t")[0]["pos"].alias("begin"), text("initial").alias("initials"), text("fault").alias("faults"))
    lines = store(lines.mapInArrow(_summaries, "conv_id long, chunk long, begin long, initials string, faults string, m array<long>, illegal long"))
    summary = F.struct("chunk", "m", "illegal", F.left(F.col("initials"), F.lit(1)).alias("first"), F.right(F.col("initials"), F.lit(1)).alias("last"))
    ends = (lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(summary)).alias("parts"))
            .mapInArrow(_chained, "conv_id long, chunk long, end array<long>, cost long, illegal long"))
    ways = lines.drop("illegal", "m").alias("l").join(ends.alias("e"), F.col("l.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("l.chunk") == F.col("e.chunk")))
    ways = ways.select("l.conv_id", "l.chunk", "begin", "initials", "faults", "end", "cost", "illegal").mapInArrow(
        _traced, "conv_id long, chunk long, begin long, steps array<string>, outs array<int>, cost long, illegal long")
    plans = (ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "begin", "steps", "outs", "cost", "illegal"))).alias("parts"))
             .mapInArrow(_picked, "conv_id long, cost long, illegal long, audit string, picked array<struct<begin:long,steps:string>>"))
    return marks, store(plans)


def _stream(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns and their edits in order, each conversation in one task: an edit comes just before its turn."""
    edits = plans.select("conv_id", F.explode("picked").alias("p")).select("conv_id", "p.begin", "p.steps").mapInArrow(
        _edit_rows, "conv_id long, pos long, sub int, role string")
    both = turns.select("conv_id", "pos", F.lit(OWN).alias("sub"), F.lit(1).alias("kind"), "role", "text").unionByName(
        edits.select("conv_id", "pos", "sub", F.lit(0).alias("kind"), "role", F.lit(None).cast("string").alias("text")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub", "kind")


def _kept(batches):
    """``(conv_id, role, text)`` of the repaired turns in a sorted stream."""
    waiting = None  # an edit of the turn that comes next
    for batch in batches:
        for conv, pos, sub, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0 and sub < OWN:
                yield conv, role, ""
            elif kind == 0:
                waiting = conv, pos, role
            elif waiting is not None and waiting[:2] == (conv, pos):
                yield conv, waiting[2] or role, text
                waiting = None


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _turn_rows(batches):
    held, size, last, place = [], 0, (), 0
    for conv, role, text in _kept(batches):
        place = place + 1 if (conv,) == last else 0
        last = (conv,)
        held.append((conv, place, role, text))
        size += 50 + len(text)
        if size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _TURNS)], schema=_TURNS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _TURNS)], schema=_TURNS)


def _digests(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    ids, hashes, last, sha = [], [], None, None
    for conv, role, text in _kept(batches):
        if last != (conv,):
            if last:
                ids.append(last[0])
                hashes.append(sha.hexdigest())
            last, sha = (conv,), hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{role}:{text}".encode())
    if last:
        ids.append(last[0])
        hashes.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], schema=schema)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations of ``rows(conv_id, turn, role, text)``, turns numbered from 0."""
    turns = ordered(rows)
    _, plans = repair(turns, chunk)
    return _stream(turns, plans).mapInArrow(_turn_rows, "conv_id long, turn long, role string, text string")


def report(rows: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cost, audit and digest of the repaired form for every ``conv_id`` of ``ids`` (null is one)."""
    turns = ordered(rows)
    marks, plans = repair(turns, chunk)
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    names = {"blank": "b", "duplicate": "d", "truncated": "t"}
    by_turn = marks.groupBy("conv_id", "turn").agg(*[count(f).alias(n) for n, f in names.items()])
    facts = by_turn.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *[F.sum(n).alias(n) for n in names])
    digests = _stream(turns, plans).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    rows = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (facts, plans.drop("picked"), digests):
        rows = rows.unionByName(part, allowMissingColumns=True)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.groupBy("conv_id").agg(*[F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in longs],
                                       F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with every twentieth turn dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), case.alias("case")).where("case <> 0")
    text: Column = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy")).drop("copy")
