"""Streaming forms: idempotent ingest by key, and the gap check with its state. Extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeseries import BAD, GOOD, UNUSUAL, Interval
from ..operators.store import append_or_conflict


def ingest(stream: DataFrame, table: str, keys: list[str], checkpoint: str, on_conflict: Callable[[DataFrame, int], None] | None = None):
    """A query that appends new rows of each batch to a table; conflicting ones go to on_conflict."""

    def batch(df: DataFrame, epoch: int) -> None:
        clash = append_or_conflict(df.sparkSession, table, df, keys, mode="report")
        if on_conflict:
            on_conflict(clash, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def gap_check(stream: DataFrame, series: str, ts: str, ordinal: str, interval: Interval) -> DataFrame:
    """series, ordinal, quality: each element against the one before it, across batches.

    The floor of each time is computed by Spark before the state is met; the
    state is the floor of the last element. A series' first element is reported
    at once, as it cannot be known that no other will follow.
    """
    ready = stream.select(F.col(series).cast("string").alias("series"), F.col(ordinal).cast("long").alias("ordinal"), F.col(ts).cast("timestamp").alias("at"), interval.floor(F.col(ts)).cast("timestamp").alias("floor"), (interval.floor(F.col(ts)) + interval.delta).cast("timestamp").alias("next"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ordinal")
        due, out = (pd.Timestamp(state.get[0]) if state.exists else None), []
        for r in rows.itertuples():
            if r.at != r.floor:
                out.append(BAD)
            elif due is None or r.at == due:
                out.append(GOOD)
            else:
                out.append(UNUSUAL if r.at > due else BAD)
            due = r.next
        state.update((due.isoformat(),))
        yield pd.DataFrame({"series": key[0], "ordinal": rows["ordinal"], "quality": out})

    return ready.groupBy("series").applyInPandasWithState(step, "series string, ordinal long, quality string", "due string", "append", GroupStateTimeout.NoTimeout)


def interval_rollup(stream: DataFrame, series: str, ts: str, value: str, interval: Interval, late: str = "1 hour") -> DataFrame:
    """series, slot, n, mean, least, most of each grid interval; a slot is given out once no row as late as `late` can reach it.

    Rows that come later than that are left out, as the watermark says. Months
    have no fixed length, so they have no window here.
    """
    if interval in (Interval.UNDEF, Interval.MONTH1):
        raise ValueError(f"{interval} has no fixed length")
    # Weeks start on a Monday; the epoch was a Thursday.
    start = "4 days" if interval is Interval.WEEK1 else "0 seconds"
    slot = F.window(F.col(ts), interval.value.removeprefix("INTERVAL ").lower(), None, start)
    found = stream.withWatermark(ts, late).groupBy(F.col(series).alias("series"), slot.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return found.select("series", F.col("w.start").alias("slot"), "n", "mean", "least", "most")
