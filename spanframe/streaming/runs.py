"""Streaming run collapse: the last value per process is the only state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "process string, event_id bigint, value string, pos bigint"
STATE = "last string, n bigint"


def collapse_stream(stream: DataFrame) -> DataFrame:
    """Rows of ``stream(process, ts, event_id, value)`` that differ from the row before them.

    Input files must arrive in time order per process; order inside a micro-batch is restored here.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = pdf["value"] != pdf["value"].shift(fill_value=last if last is not None else "\u0000")
        out = pdf[keep]
        yield pd.DataFrame({"process": out["process"], "event_id": out["event_id"], "value": out["value"], "pos": range(n, n + len(out))})
        state.update((pdf["value"].iloc[-1], n + len(out)))

    return stream.groupBy("process").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
