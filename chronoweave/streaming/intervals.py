"""Interval formation on a stream of symbolic points, as an extension: the same intervals as operators.intervals.merge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity long, variable int, state int, start long, end long"


def stream(points: DataFrame, max_gap: int) -> DataFrame:
    """Closed intervals of (entity, variable, time, state) points that come in order of time; one open interval is kept
    for each entity and variable and given out when another state or a gap ends it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        done = []
        for f in frames:
            for t, s in f.sort_values("time")[["time", "state"]].itertuples(index=False):
                t, s = int(t), int(s)
                if held and held[0] == s and t - held[2] <= max_gap:
                    held = (s, held[1], t + 1)
                else:
                    if held:
                        done.append((*key, *held))
                    held = (s, t, t + 1)
        if held:
            state.update(held)
        yield pd.DataFrame(done, columns=["entity", "variable", "state", "start", "end"])

    return points.groupBy("entity", "variable").applyInPandasWithState(step, OUT, "state int, start long, end long", "append", GroupStateTimeout.NoTimeout)
