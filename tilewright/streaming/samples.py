"""Online operators: line tails, idle detection with a timeout, matching of timer queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators.load_bench import IDLE_FRAMES, LOAD_TIMEOUT_MS
from tilewright.plans import ship

LOAD_SCHEMA = "codec string, rep int, loaded_at double, state string"


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the text files in a folder, trimmed, without blank ones."""
    return spark.readStream.text(path).select(F.trim("value").alias("value")).where("value <> ''")


class IdleDetector(StatefulProcessor):
    """Per run: counts frames with nothing pending or processing; ends at the idle run or past the timeout, once.

    Where frames come ``live``, a timer in processing time ends runs whose frames
    stop: it is set anew with each batch of frames, for what is left of the timeout.
    """

    def __init__(self, timeout_ms: float = LOAD_TIMEOUT_MS, live: bool = False):
        self.timeout_ms, self.live = timeout_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "idle int, ended boolean, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        idle, ended, last = self.state.get() if self.state.exists() else (0, False, 0.0)
        out = []
        for frame in rows:
            for t, pending, processing in frame.sort_values("t")[["t", "pending", "processing"]].itertuples(index=False):
                if ended:
                    break
                idle, last = (idle + 1 if pending == 0 and processing == 0 else 0), float(t)
                if idle >= IDLE_FRAMES or t > self.timeout_ms:
                    ended = True
                    out.append((*key, last, "loaded" if idle >= IDLE_FRAMES else "timeout"))
        self.state.update((int(idle), bool(ended), last))
        if self.live:
            now = timer_values.getCurrentProcessingTimeInMs()
            for at in [*self.handle.listTimers()]:
                self.handle.deleteTimer(at)
            if not ended:
                self.handle.registerTimer(int(now + max(0.0, self.timeout_ms - last) + 1))
        yield pd.DataFrame(out, columns=["codec", "rep", "loaded_at", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        idle, ended, last = self.state.get()
        self.state.update((idle, True, last))
        yield pd.DataFrame([] if ended else [(*key, float(self.timeout_ms), "timeout")], columns=["codec", "rep", "loaded_at", "state"])

    def close(self) -> None:
        pass


def detect_loaded(frames: DataFrame, timeout_ms: float = LOAD_TIMEOUT_MS, live: bool = False) -> DataFrame:
    """(codec, rep, loaded_at, state) as soon as a run's frames (codec, rep, t, pending, processing) show it; frames of a run arrive in order.

    With ``live`` a run whose frames stop is a ``timeout`` once the time is over,
    and the stream goes on while such timers wait; recorded frames need none.
    """
    ship(frames.sparkSession)
    return frames.groupBy("codec", "rep").transformWithStateInPandas(IdleDetector(timeout_ms, live), LOAD_SCHEMA, "Append", "ProcessingTime" if live else "None")


def timer_results(started: DataFrame, ended: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(query, t, gpu_ms): starts (query, t, at) joined with ends (query, ns, disjoint, at); disjoint measurements are dropped.

    Both sides carry watermarks, and an end follows its start within ``late``, so that state goes.
    """
    a = started.withWatermark("at", late).select("query", "t", F.col("at").alias("start_at"))
    b = ended.withWatermark("at", late).where("NOT disjoint").select(F.col("query").alias("q"), "ns", F.col("at").alias("end_at"))
    met = a.join(b, F.expr(f"query = q AND end_at >= start_at AND end_at <= start_at + INTERVAL {late}"))
    return met.select("query", F.round("t").alias("t"), F.round(F.col("ns") / 1e6, 2).alias("gpu_ms"))
