"""First-in-first-out request/response correlation.

Each response goes to the earliest pending request that accepts it; a response
that arrives with no such request is ignored.  For one request kind this is
native (``fifo_pairs``):

* ``cum``  = running (+1 request, -1 response),
* ``flo``  = min(0, minimum of ``cum`` strictly before the row),
* a response with ``cum < flo`` found the queue empty (unmatched),
* the n-th request pairs with the n-th matched response.

All three are skew-safe running scans, and the pairing is an equi-join on
``(session, n)``.

Several request kinds (``fifo_pairs_by_kind``) fall into queues: kinds that
share no response never compete.  Request kinds that accept the same responses
are one queue, whose summary is the pair of numbers above.  Where kinds accept
different, overlapping responses, the age of every pending request matters and
no such summary exists; those queues are replayed in blocks of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence, Set

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, checkpoint as _ckpt
from .scan import row_number, running

BLOCK_ROWS = 500_000  # rows of one session that a task replays at a time


def fifo_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], is_request: Column,
               is_response: Column, id_col: str) -> DataFrame:
    """``(by..., req_<id>, resp_<id>)`` for every matched pair."""
    by = list(by)
    e = (df.select(*by, *order, id_col,
                   F.when(is_request, F.lit("R")).when(is_response, F.lit("S")).alias("__k"))
         .where(F.col("__k").isNotNull()))
    step = F.when(F.col("__k") == "R", 1).otherwise(-1)
    ensure_checkpoint_dir(df.sparkSession)
    c = _ckpt(running(e, by, order, {"__cum": ("sum", step)}))
    f = running(c, by, order, {"__min": ("min", F.col("__cum"))}, exclusive=True)
    f = f.withColumn("__flo", F.least(F.lit(0), F.coalesce("__min", F.lit(0))))
    ok = _ckpt(f.where((F.col("__k") == "R") | (F.col("__cum") >= F.col("__flo"))))
    n = running(ok.select(*by, *order, id_col, "__k"), by + ["__k"], order, {"__n": ("sum", F.lit(1))})
    req = n.where(F.col("__k") == "R").select(*by, "__n", F.col(id_col).alias(f"req_{id_col}"))
    resp = n.where(F.col("__k") == "S").select(*[F.col(b).alias(f"__s_{b}") for b in by],
                                               F.col("__n").alias("__sn"), F.col(id_col).alias(f"resp_{id_col}"))
    same = F.col("__n") == F.col("__sn")
    for b in by:  # a null session is a session, too
        same = same & F.col(b).eqNullSafe(F.col(f"__s_{b}"))
    return req.join(resp, same).select(*by, f"req_{id_col}", f"resp_{id_col}")


def queues(accepts: Mapping[str, Set[str]]) -> list[dict[str, frozenset[str]]]:
    """``accepts`` split into independent queues: kinds of one queue are connected through shared responses.

    A name that is a request kind is never a response; kinds left without a response form no queue."""
    left = {k: frozenset(v).difference(accepts) for k, v in accepts.items()}
    found: list[dict[str, frozenset[str]]] = []
    for kind in sorted(k for k, v in left.items() if v):
        merged = {kind: left[kind]}
        apart = []
        for q in found:
            if left[kind] & frozenset().union(*q.values()):
                merged |= q
            else:
                apart.append(q)
        found = [*apart, merged]
    return found


def fifo_pairs_by_kind(df: DataFrame, by: Sequence[str], order: Sequence[str], id_col: str, kind_col: str,
                       accepts: Mapping[str, Set[str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(by..., req_<id>, resp_<id>)`` for every matched pair, request kinds accepting sets of response kinds.

    ``accepts[kind]`` holds the response kinds that a request of that kind takes. ``order`` is unique within a
    session. A null session is a session, rows of other or null kinds are ignored, an empty table or dictionary
    gives no rows.

    Queues of one accepted set are matched natively, all in one pass keyed by session and queue. In the others a
    session advances by ``block_rows`` rows a round, all sessions together: a round's task holds that many rows and,
    for each kind, at most as many waiting requests as the block has responses for it. Results do not depend on
    ``block_rows``; sessions that fit in a block need one round."""
    by, order = list(by), list(order)
    found = queues(accepts)
    plain = [q for q in found if len(set(q.values())) == 1]
    mixed = [q for q in found if len(set(q.values())) > 1]
    parts = []
    if plain:
        parts.append(_one_set(df, by, order, id_col, kind_col, plain))
    for q in mixed:
        parts.append(_replay(df, by, order, id_col, kind_col, q, block_rows))
    if not parts:
        return (df.select(*by, F.col(id_col).alias(f"req_{id_col}"), F.col(id_col).alias(f"resp_{id_col}"))
                .where(F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_set(df: DataFrame, by: list[str], order: list[str], id_col: str, kind_col: str,
             plain: list[dict[str, frozenset[str]]]) -> DataFrame:
    """Queues whose kinds all accept the same responses, matched together."""
    kind = F.col(kind_col)
    number = is_request = F.lit(None)
    for i, q in enumerate(plain):
        asked, answers = sorted(q), sorted(next(iter(q.values())))
        is_request = F.when(kind.isin(asked), True).when(kind.isin(answers), False).otherwise(is_request)
        number = F.when(kind.isin(asked + answers), i).otherwise(number)
    e = df.select(*dict.fromkeys([*by, *order, id_col]), is_request.alias("__asks"), number.alias("__queue"))
    return fifo_pairs(e.where("__queue is not null"), [*by, "__queue"], order, F.col("__asks"), ~F.col("__asks"),
                      id_col).drop("__queue")


def _replay(df: DataFrame, by: list[str], order: list[str], id_col: str, kind_col: str,
            accepts: dict[str, frozenset[str]], block_rows: int) -> DataFrame:
    """One queue of overlapping kinds, replayed block by block."""
    req, resp = f"req_{id_col}", f"resp_{id_col}"
    kinds = sorted(accepts.keys() | frozenset().union(*accepts.values()))
    e = (df.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)],
                   *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
                   F.col(id_col).alias("__id"), F.col(kind_col).alias("__kind"))
         .where(F.col("__kind").isin(kinds)))
    keys, sort = [f"__b{i}" for i in range(len(by))], [f"__o{i}" for i in range(len(order))]
    rows = _ckpt(row_number(e, keys, sort, "__n")
                 .select("*", F.floor((F.col("__n") - 1) / block_rows).alias("__block")).drop("__n"))
    last = rows.agg(F.max("__block")).first()[0]
    cols = [*keys, *sort, "__id", "__kind"]
    schema = StructType([*rows.select(*cols).schema.fields,
                         *rows.select(F.col("__id").alias("__resp")).schema.fields])
    match = _matcher(accepts, sort)
    pairs, waiting = [], None
    for block in range(0 if last is None else last + 1):
        now = rows.where(F.col("__block") == block).select(*cols)
        if waiting is not None:
            ranked = _ckpt(_with_quota(waiting, now, keys, sort, accepts))
            now = now.unionByName(ranked.where("__rank <= __quota").select(*cols))
        done = _ckpt(now.groupBy(*keys).applyInArrow(match, schema))
        pairs.append(done.where("__resp is not null"))
        kept = done.where("__resp is null").select(*cols)
        waiting = kept if waiting is None else kept.unionByName(ranked.where("__rank > __quota").select(*cols))
    found = pairs[0] if pairs else rows.select(*cols, F.col("__id").alias("__resp")).where(F.lit(False))
    for p in pairs[1:]:
        found = found.unionByName(p)
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("__id").alias(req),
                        F.col("__resp").alias(resp))


def _with_quota(waiting: DataFrame, now: DataFrame, keys: list[str], sort: list[str],
                accepts: dict[str, frozenset[str]]) -> DataFrame:
    """Waiting requests with their rank by age within session and kind (``__rank``) and the number of responses of
    the block that their kind accepts (``__quota``); later ranks cannot be reached in this block."""
    takers: dict[str, list[str]] = {}
    for kind, answers in accepts.items():
        for a in answers:
            takers.setdefault(a, []).append(kind)
    asked = F.lit(None).cast("array<string>")
    for answer, kinds in takers.items():
        asked = F.when(F.col("__kind") == answer, F.array(*[F.lit(k) for k in kinds])).otherwise(asked)
    quota = (now.select(*[F.col(k).alias(f"__q{k}") for k in keys], F.explode(asked).alias("__asked"))
             .groupBy(*[f"__q{k}" for k in keys], "__asked").agg(F.count(F.lit(1)).alias("__quota")))
    same = F.col("__kind") == F.col("__asked")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__q{k}"))
    ranked = row_number(waiting, [*keys, "__kind"], sort, "__rank")
    return (ranked.join(quota, same, "left")
            .select(*waiting.columns, "__rank", F.coalesce("__quota", F.lit(0)).alias("__quota")))


def _matcher(accepts: dict[str, frozenset[str]], sort: list[str]):
    """Replay of one session's block: every request with the response it got, or null."""
    takers: dict[str, list[str]] = {}
    for kind, answers in accepts.items():
        for a in answers:
            takers.setdefault(a, []).append(kind)

    def match(table: pa.Table) -> pa.Table:
        by_age = pc.sort_indices(table, sort_keys=[(o, "ascending") for o in sort], null_placement="at_start")
        table = table.take(by_age)
        pending = {k: deque() for k in accepts}
        got: dict[int, int | None] = {}
        for i, kind in enumerate(table["__kind"].to_pylist()):
            if kind in pending:
                pending[kind].append(i)
                got[i] = None
                continue
            heads = [pending[k] for k in takers[kind] if pending[k]]
            if heads:
                got[min(heads, key=lambda q: q[0]).popleft()] = i
        requests = table.take(pa.array(got.keys(), pa.int64()))
        return requests.append_column("__resp", table["__id"].take(pa.array(got.values(), pa.int64())))

    return match
