"""Online request/response correlation.

State per session is the queue of pending request ids -- bounded by how many
requests wait, not by the session's length.  Events of a session must arrive
in order across micro-batches (within a batch they are sorted by ``order``).
A response may be accepted by several request kinds; it goes to the earliest
pending request that accepts it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fifo_state_fn(key_col: str, order_col: str, id_col: str, kind_col: str,
                  accepts: dict[str, set[str]]):
    """Build the ``applyInPandasWithState`` function.

    ``accepts[request_kind]`` is the set of response kinds that request accepts;
    any kind that is not a request kind is a response.
    """

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending: list[tuple[int, str]] = []
        if state.exists:
            ids, kinds = state.get
            pending = list(zip(list(ids), list(kinds)))
        frames = [p for p in pdfs]
        out_req, out_resp = [], []
        if frames:
            pdf = pd.concat(frames).sort_values(order_col, kind="stable")
            for eid, kind in zip(pdf[id_col].tolist(), pdf[kind_col].tolist()):
                if kind in accepts:
                    pending.append((int(eid), kind))
                    continue
                for i, (rid, rkind) in enumerate(pending):
                    if kind in accepts[rkind]:
                        out_req.append(rid)
                        out_resp.append(int(eid))
                        del pending[i]
                        break
        state.update(([p[0] for p in pending], [p[1] for p in pending]))
        yield pd.DataFrame({key_col: [key[0]] * len(out_req), f"req_{id_col}": out_req,
                            f"resp_{id_col}": out_resp})

    return fn


def online_fifo(events: DataFrame, key_col: str, order_col: str, id_col: str, kind_col: str,
                accepts: dict[str, set[str]]) -> DataFrame:
    """W4 on a streaming (or batch) DataFrame: matched ``(key, req_id, resp_id)``."""
    kt = dict(events.dtypes)[key_col]
    out_schema = f"{key_col} {kt}, req_{id_col} bigint, resp_{id_col} bigint"
    state_schema = "ids array<bigint>, kinds array<string>"
    fn = fifo_state_fn(key_col, order_col, id_col, kind_col, accepts)
    return (events.select(key_col, order_col, id_col, kind_col).groupBy(key_col)
            .applyInPandasWithState(fn, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout))
