"""Incremental chronological encoding: closed runs leave as soon as a later group ends them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "room string, event long, start_index long, end_index long"
STATE = "next_index long, events array<long>, starts array<long>"


def append_runs(groups: DataFrame) -> DataFrame:
    """``groups``: a stream of (room, sg, events array<long>), a full set for each group, in rising order of sg across batches.

    State for each room is its open runs and the next index.  Runs still open are not emitted; they are the state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, events, starts = state.get if state.exists else (0, [], [])
        open_ = dict(zip(events, starts))
        rows = pd.concat(list(frames)).sort_values("sg")
        out = []
        for members in rows["events"]:
            now = {int(x) for x in members}
            out += [(key[0], e, s, at) for e, s in open_.items() if e not in now]
            open_ = {e: open_.get(e, at) for e in sorted(now)}
            at += 1
        state.update((at, list(open_), list(open_.values())))
        yield pd.DataFrame(out, columns=["room", "event", "start_index", "end_index"])

    return groups.groupBy("room").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
