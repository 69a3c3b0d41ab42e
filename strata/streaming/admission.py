"""Sliding-log admission: at most ``limit`` admitted requests of a client within the window.

Refused requests leave no trace, so this is no count over a range of rows: each
decision depends on those before.  The state of a client is its last ``limit``
admissions at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "client string, ts timestamp, request_id bigint, admitted boolean"


def decide(times: Iterator[int], limit: int, window_us: int, log: deque) -> list[bool]:
    """Decisions for times in order; ``log`` holds admissions still in the window and is updated."""
    out = []
    for t in times:
        while log and log[0] <= t - window_us:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out


def admit(requests: DataFrame, limit: int = 20, window_s: int = 60) -> DataFrame:
    """``admitted`` for each (client, ts, request_id) row, in order of time and id.

    A client's rows are streamed in sorted order through one task, holding at
    most ``limit`` admissions, so a hot client costs time but no memory.
    """
    ordered = requests.select(F.col("client").cast("string").alias("client"), "ts", "request_id").repartition("client").sortWithinPartitions("client", "ts", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = object(), deque()
        for batch in batches:
            admitted = []
            times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            for who, t in zip(batch["client"].tolist(), times):
                if who != client:
                    client, log = who, deque()
                admitted += decide([t], limit, window_s * 1_000_000, log)
            yield batch.assign(admitted=admitted)[["client", "ts", "request_id", "admitted"]]

    return ordered.mapInPandas(run, OUT)


class _Admission(StatefulProcessor):
    """A client's requests wait until the watermark has passed them and are then decided in order of time and id."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, request_id bigint")
        self.log = handle.getListState("log", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(t, i) for part in rows for t, i in zip(part["ts"].astype("datetime64[us]").astype("int64").tolist(), part["request_id"].tolist())]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # rows before this can no longer come
        rows = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        log = deque(t for (t,) in self.log.get()) if self.log.exists() else deque()
        admitted = decide([t for t, _ in due], self.limit, self.window_us, log)
        while log and log[0] <= min([passed, *(t for t, _ in rest)]) - self.window_us:
            log.popleft()
        for state, values in ((self.waiting, rest), (self.log, [(t,) for t in log])):
            state.put(values) if values else state.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif log:  # an idle client is forgotten when its last admission has left the window
            self.handle.registerTimer((log[-1] + self.window_us) // 1000 + 1)
        if due:
            yield pd.DataFrame({"client": key[0], "ts": pd.to_datetime([t for t, _ in due], unit="us"), "request_id": [i for _, i in due], "admitted": admitted})

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int = 20, window_s: int = 60, late: str = "10 seconds") -> DataFrame:
    """The same on a stream of (client, ts, request_id), in event time: decisions are those of ``admit`` over all rows that are not late.

    Requests may come out of order by up to ``late``; each is decided when the watermark has
    passed it, so a decision is ``late`` behind the newest request.  Rows behind the
    watermark are dropped (``dropped`` counts them).  State is the waiting requests and at
    most ``limit`` admissions of a client, and goes by an event-time timer, not by the
    clock: a backlog is judged like live traffic.  Sets the session's state store to RocksDB.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = requests.select(F.col("client").cast("string").alias("client"), "ts", "request_id").withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(_Admission(limit, window_s * 1_000_000), OUT, "append", "EventTime")


def stalest(logs: DataFrame, most: int = 5000, drop: int = 1000) -> DataFrame:
    """The ``drop`` clients of (client, last) whose last admission is longest ago, if there are more than ``most``; none otherwise."""
    many = logs.agg(F.count("*").alias("clients"))  # a single row
    rows = logs.orderBy(F.asc_nulls_first("last"), "client").limit(drop)
    return rows.crossJoin(F.broadcast(many)).where(F.col("clients") > most).select("client", "last")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests by client and session: a session ends where nothing came for ``gap``.  On streams sessions come when the watermark has closed them."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count("*").alias("requests"))
    return grouped.select("client", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests")


def dropped(query: StreamingQuery) -> int:
    """Rows of a query so far that came behind its watermark and were left out."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def windowed_counts(requests: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by client and tumbling window, for streams with a watermark and batches alike."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    return rows.groupBy(F.window("ts", size).alias("w"), "client").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), "client", "requests")
