"""The latest belief of each source about each event, kept up to date over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from credence.operators.viewpoint import EVENT

OUT = "sensor string, event_start timestamp, source string, belief_time timestamp, cumulative_probability double, event_value double"
STATE = "belief_time timestamp, cumulative_probability array<double>, event_value array<double>"


def latest_beliefs(stream: DataFrame, late_by: str = "1 day") -> DataFrame:
    """A streaming DataFrame in update mode: all points of each event's and source's latest belief, whenever that changes.

    The watermark is on belief times: a belief that arrives later than ``late_by`` behind
    the latest one of the stream is dropped, whatever event it is about, and events of any
    date take beliefs. An event's state goes when no belief in time could be older than it.
    """
    known = stream.where("event_value is not null").withWatermark("belief_time", late_by)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest, points = None, {}
        if state.exists:
            latest, probabilities, values = state.get
            latest = pd.Timestamp(latest)
            points = dict(zip(probabilities, values))
        before = (latest, dict(points))
        for rows in batches:
            newest = rows["belief_time"].max()
            if latest is None or newest > latest:
                latest, points = newest, {}
            some = rows[rows["belief_time"] == latest]
            points |= dict(zip(some["cumulative_probability"].tolist(), some["event_value"].tolist()))
        state.update((latest.to_pydatetime(), list(points), list(points.values())))
        state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        if (latest, points) != before:
            out = pd.DataFrame({"cumulative_probability": list(points), "event_value": list(points.values())})
            yield out.assign(sensor=key[0], event_start=key[1], source=key[2], belief_time=latest)[[c.split()[0] for c in OUT.split(", ")]]

    return known.groupBy(*EVENT).applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def write_latest(stream: DataFrame, path: str, late_by: str = "1 day"):
    """Starts writing a stream's latest beliefs below ``path``, a folder for each batch, until what is there is read; gives the query."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    writer = latest_beliefs(stream, late_by).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
