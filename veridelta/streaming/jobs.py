"""Stream jobs: ledgers, windowed profiles and checks, deduplication, alerts, late events. State is bounded by watermarks."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..operators.checks import Check, run_checks


def stream_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines as a stream; lines that can't be read give nulls and keep their text in _corrupt_record, if schema has it."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a timestamp in the session's zone, which watermarks need, with a watermark where df is a stream."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if df.isStreaming else out


def windowed_profile(df: DataFrame, ts: str, size: str, cols: list[str], late: str = "1 hour") -> DataFrame:
    """day (start of the window), rows, and per column nulls and approximate distinct values."""
    g = timed(df, ts, late).groupBy(F.window(ts, size).alias("w"))
    out = g.agg(F.count("*").alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols], *[F.approx_count_distinct(c).alias(f"{c}_distinct") for c in cols])
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def profile_drift(batch: DataFrame, baseline: DataFrame, c: str, step: float = 0.15) -> DataFrame:
    """For foreachBatch: windows whose null rate is further than step from the baseline's (one row: null_rate)."""
    rate = F.col(f"{c}_nulls") / F.col("row_count")
    return batch.crossJoin(F.broadcast(baseline.select("null_rate"))).where(F.abs(rate - F.col("null_rate")) > step).select("window_start", F.lit(c).alias("column_name"), rate.alias("null_rate_now"), "null_rate")


def windowed_trends(df: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Rows per ISO week. Windows count from a Thursday, so they start four days later."""
    g = timed(df, ts, late).groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("runs"))
    return g.select(F.col("w.start").alias("week_start"), "runs")


def monthly(days: DataFrame) -> DataFrame:
    """Months from daily windows, in batch: a month is no fixed window."""
    return days.groupBy(F.date_format("window_start", "yyyy-MM").alias("month")).agg(F.sum("row_count").alias("row_count"))


def dedupe_drift(df: DataFrame, ts: str, keys: list[str], ttl: str) -> DataFrame:
    """The first event of each hash of the keys within the time to live."""
    out = timed(df, ts, ttl).withColumn("drift_hash", F.sha2(F.concat_ws("|", *keys), 256))
    return out.dropDuplicatesWithinWatermark(["drift_hash"]) if df.isStreaming else out.dropDuplicates(["drift_hash"])


def cooldown_alerts(df: DataFrame, key: str, ts: str, minutes: int = 30) -> DataFrame:
    """Events of each key that come at least `minutes` after its last alert. The state is one time per key, which a timer clears.

    A task keeps eight bytes for each distinct time of a key in one batch; the source's maxBytesPerTrigger bounds a batch.
    Events without a time are left out; events of one time count once.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = minutes * 60_000

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out: list[int] = []
        times = np.unique(np.concatenate([p["at"].unique() for p in parts]))
        i = 0 if last is None else np.searchsorted(times, last + span)
        while i < len(times):
            last = int(times[i])
            out.append(last)
            i = np.searchsorted(times, last + span)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "at": out})

    rows = timed(df, ts, f"{minutes} minutes").select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_millis(ts).alias("at")).where("at is not null")
    return rows.groupBy("key").applyInPandasWithState(each, "key string, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def late_events(df: DataFrame, ts: str, arrival: str, key: str, minutes: Column | int) -> DataFrame:
    """Rows that arrive after their key's newest event time by more than the tolerance, in order of arrival.

    Rows are dealt by ranges of key and arrival, so that a hot key lies in many; each range starts from the newest time of
    the key's earlier ranges. Rows without a time are never late; a null key is a key.
    """
    from pyspark.sql import Window as W

    # written once, since the ranges are read twice and must not be dealt anew
    rows = cut(df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).repartitionByRange(key, arrival).withColumn("__p", F.spark_partition_id()))
    ranges = rows.groupBy(F.struct(key).alias("__k"), "__p").agg(F.max("__t").alias("__m"))
    earlier = F.max("__m").over(W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    j = rows.withColumn("__k", F.struct(key)).join(ranges.select("__k", "__p", earlier.alias("__e")), ["__k", "__p"])
    within = W.partitionBy("__k", "__p").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    newest = F.greatest(F.max("__t").over(within), "__e")
    late = j.withColumn("lag_minutes", (newest - F.col("__t")) / 60e6).where(F.col("lag_minutes") > minutes)
    return late.select(*df.columns, "lag_minutes")


def late_stream(df: DataFrame, rid: str, ts: str, arrival: str, key: str, minutes: int, keep_days: int = 90) -> DataFrame:
    """key, rid, arrival, lag_minutes of a stream's rows that arrive after their key's newest event time by more than the tolerance.

    The state of a key is its newest event time, beside a timer that clears it once the watermark, keep_days behind the newest
    time of all, is keep_days past it: rows that come then are newer than what is forgotten, older ones were dropped by the
    watermark (see run_to_table, which counts them). Within a batch rows count in order of arrival, ties by rid; a task
    keeps three numbers for each row of a key in one batch, which the source's maxBytesPerTrigger bounds. Rows without a
    time are never late. rid and arrival are longs, key a string. The state store is RocksDB, which this sets.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    tolerance, keep = minutes * 60_000_000, keep_days * 86_400_000
    none = np.iinfo(np.int64).min

    class Late(StatefulProcessor):
        def init(self, handle: Any) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", T.StructType([T.StructField("t", T.LongType())]))

        def handleInputRows(self, k: tuple, rows: Any, timers: Any) -> Iterator[pd.DataFrame]:
            parts = [(p["rid"].to_numpy(np.int64), p["arrival"].to_numpy(np.int64), p["t"].to_numpy(np.int64)) for p in rows]
            rid, at, t = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((rid, at))
            rid, at, t = rid[order], at[order], t[order]
            first = self.newest.get()[0] if self.newest.exists() else none
            newest = np.maximum.accumulate(np.concatenate([[first], t]))
            known = newest[:-1] != none
            lag = np.where(known, newest[:-1], t) - t
            late = lag > tolerance
            if newest[-1] > first:
                self.newest.update((int(newest[-1]),))
                self.handle.registerTimer(int(newest[-1]) // 1000 + keep)
            yield pd.DataFrame({"key": pd.Series([k[0]] * int(late.sum()), dtype=object), "rid": rid[late], "arrival": at[late], "lag_minutes": lag[late] / 60e6})

        def handleExpiredTimer(self, k: tuple, timers: Any, expired: Any) -> Iterator[pd.DataFrame]:
            if self.newest.exists() and self.newest.get()[0] // 1000 + keep <= expired.getExpiryTimeInMs():
                self.newest.clear()
            yield pd.DataFrame({"key": pd.Series([], dtype=object), "rid": pd.Series([], dtype="int64"), "arrival": pd.Series([], dtype="int64"), "lag_minutes": pd.Series([], dtype="float64")})

        def close(self) -> None:
            pass

    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = timed(df, ts, f"{keep_days} days").where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(rid).cast("long").alias("rid"), F.col(arrival).cast("long").alias("arrival"), F.col(ts), F.unix_micros(ts).alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(Late(), "key string, rid long, arrival long, lag_minutes double", "append", "eventTime")


def windowed_checks(df: DataFrame, ts: str, size: str, plan: dict[str, Check], late: str = "1 hour") -> DataFrame:
    """The checks of a plan for each window."""
    out = run_checks(timed(df, ts, late), plan, [F.window(ts, size).alias("w")])
    return out.select(F.col("w.start").alias("window_start"), "check", "metric", "status")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, **options: Any) -> int:
    """Runs over all files there are and appends to parquet, exactly once with the checkpoint folder. Returns how many rows
    came behind the watermark and were dropped, over all batches of this run."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def __init__(self) -> None:
            self.dropped: dict[str, int] = defaultdict(int)
            self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

        def onQueryStarted(self, event: Any) -> None: ...

        def onQueryProgress(self, event: Any) -> None:
            self.dropped[str(event.progress.runId)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

        def onQueryIdle(self, event: Any) -> None: ...

        def onQueryTerminated(self, event: Any) -> None:
            self.ended[str(event.runId)].set()

    listener = Progress()
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True)
    stream.sparkSession.streams.addListener(listener)
    try:
        query = writer.start()
        query.awaitTermination()
        listener.ended[str(query.runId)].wait(30)  # events come after the query's end
    finally:
        stream.sparkSession.streams.removeListener(listener)
    return listener.dropped[str(query.runId)]
