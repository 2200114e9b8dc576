"""Load benchmarks: network, frame and GPU samples of runs, keyed by codec and repetition.

Frames are ordered within a run by one task per run: a run ends with its
timeout, so its frames are bounded. Requests and percentiles may be grouped by
anything and are counted before any task orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["codec", "rep"]
IDLE_FRAMES, BUCKET_MS, LOAD_TIMEOUT_MS = 30, 250, 900_000
TIME_BINS = 1000


def of_folder(requests: DataFrame, folder: str, since: float) -> DataFrame:
    """Requests whose name holds a folder, from a run's start on (a millisecond of slack)."""
    return requests.where(F.contains("name", F.lit(folder)) & (F.col("start_time") >= since - 1))


def peak_concurrency(spans: DataFrame, by: list[str], start: str, end: str, bins: int = TIME_BINS) -> DataFrame:
    """Most spans open at once per group; an end goes before a start at the same instant.

    Starts and ends are counted per instant, and instants summed within and over
    ``bins`` stretches of a group's time, so that no task sorts a whole group.
    """
    events = spans.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col(start).cast("double").alias("_t"), F.lit(1).alias("_up"), F.lit(0).alias("_down")),
                F.struct(F.col(end).cast("double").alias("_t"), F.lit(0).alias("_up"), F.lit(1).alias("_down"))
            )
        )
    )
    instants = events.groupBy(*by, "_t").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
    span = instants.groupBy(*by).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    binned = instants.join(span, by).withColumn(
        "_bin", F.when(F.col("_b") > F.col("_a"), F.floor((F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins)).otherwise(0)
    ).drop("_a", "_b")
    sums = binned.groupBy(*by, "_bin").agg(F.sum(F.col("_up") - F.col("_down")).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*by, "_bin").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.col("_carried") + F.sum(F.col("_up") - F.col("_down")).over(within)
    return binned.join(carried, [*by, "_bin"]).withColumn("_open", open_).groupBy(*by).agg(F.greatest(F.max("_open"), F.lit(0)).alias("peak"))


def network_stats(requests: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Counts, megabytes, and sums and means of queued, first-byte and download times, each at least 0; a request start of 0 means none."""
    asked = F.coalesce(F.nullif(F.col("request_start"), F.lit(0.0)), F.col("fetch_start"))
    parts = {"queued": asked - F.col("fetch_start"), "ttfb": F.col("response_start") - asked, "download": F.col("response_end") - F.col("response_start")}
    rows = requests.withColumns({k: F.greatest(F.lit(0.0), v) for k, v in parts.items()})
    n = F.greatest(F.count("*"), F.lit(1))
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("requests"), F.round(F.sum(F.coalesce("transfer_size", F.lit(0))) / 1048576, 1).alias("transfer_mb"), F.round(F.sum(F.coalesce("encoded_size", F.lit(0))) / 1048576, 1).alias("encoded_mb"),
        *(F.round(F.sum(k) / n, 2).alias(f"avg_{k}_ms") for k in parts), *(F.round(F.sum(k), 0).cast("long").alias(f"total_{k}_ms") for k in parts),
    )
    return stats.join(peak_concurrency(requests, by, "fetch_start", "response_end").withColumnRenamed("peak", "peak_concurrency"), by)


def percentiles_down(rows: DataFrame, by: list[str], value: str, named: dict[str, float], digits: int = 1) -> DataFrame:
    """Per group and name the value at floor((n - 1) * p) of its sorted values, rounded; groups without values are null.

    Equal values are counted first, so that a task walks a group's distinct values.
    """
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(value).alias("_m"))
    sorted_ = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    walked = counted.withColumn("_upto", F.sum("_m").over(sorted_)).withColumn("_n", F.sum("_m").over(Window.partitionBy(*by)))
    place = lambda p: F.floor((F.col("_n") - 1) * p)
    at = lambda p: (F.col("_m") > 0) & (F.col("_upto") > place(p)) & (F.col("_upto") - F.col("_m") <= place(p))
    return walked.groupBy(*by).agg(*(F.round(F.max(F.when(at(p), F.col("_v"))), digits).alias(name) for name, p in named.items()))


def percentile_down(rows: DataFrame, by: list[str], value: str, p: float, digits: int = 1) -> DataFrame:
    """One such percentile as ``value``."""
    return percentiles_down(rows, by, value, {"value": p}, digits)


def frame_durations(frames: DataFrame, by: list[str] = RUN, t: str = "t") -> DataFrame:
    """Frames with ``frame_ms`` since the one before; the first counts from the start."""
    return frames.withColumn("frame_ms", F.round(F.col(t) - F.lag(t, 1, 0).over(Window.partitionBy(*by).orderBy(t)), 1))


def without_first(frames: DataFrame, by: list[str] = RUN, t: str = "t") -> DataFrame:
    return frames.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(t))).where("_nth > 1").drop("_nth")


def timeline(frames: DataFrame, by: list[str] = RUN, t: str = "t", bucket: float = BUCKET_MS) -> DataFrame:
    """The first frame of each bucket of time."""
    own = F.floor(F.col(t) / bucket)
    first = Window.partitionBy(*by, "_bucket").orderBy(t)
    return frames.withColumn("_bucket", own).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_bucket")


def idle_from(frames: DataFrame, by: list[str] = RUN, t: str = "t", run: int = IDLE_FRAMES) -> DataFrame:
    """(by, loaded_at): time of the frame that completes the first run of idle frames (nothing pending or processing); null if none does."""
    order = Window.partitionBy(*by).orderBy(t)
    busy = (~((F.col("pending") == 0) & (F.col("processing") == 0))).cast("int")
    island = frames.withColumn("_island", F.sum(busy).over(order)).withColumn("_busy", busy)
    nth = island.where("_busy = 0").withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(t)))
    done = nth.where(F.col("_nth") == run).groupBy(*by).agg(F.min(t).alias("loaded_at"))
    return frames.select(*by).distinct().join(done, by, "left")


def frame_summary(frames: DataFrame, gpu: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Per run: first content, drain times, greatest counters, percentiles of frame and GPU times, GPU total."""
    last = lambda c: F.coalesce(F.max(F.when(F.col(c) > 0, F.round("t"))), F.lit(0.0)).cast("long")
    base = frames.groupBy(*by).agg(
        F.round(F.min(F.when(F.col("ready") > 0, F.col("t")))).cast("long").alias("first_content_ms"), last("pending").alias("requests_done_ms"), last("processing").alias("processing_done_ms"),
        F.greatest(F.max("pending"), F.lit(0)).alias("max_pending"), F.greatest(F.max("processing"), F.lit(0)).alias("max_processing"), F.count("*").alias("frames"),
    )
    for rows, value, name in ((without_first(frames, by), "frame_ms", "frame"), (gpu, "gpu_ms", "gpu")):
        base = base.join(percentiles_down(rows, by, value, {f"{name}_ms_p50": 0.5, f"{name}_ms_p95": 0.95, f"{name}_ms_max": 1.0}), by, "left")
    total = gpu.groupBy(*by).agg(F.round(F.sum("gpu_ms"), 1).alias("gpu_ms_total"))
    return base.join(total, by, "left").withColumn("gpu_supported", F.col("gpu_ms_total").isNotNull())


def blocking_time(tasks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Time of long tasks up to the end less that up to the start."""
    upto = lambda at: F.coalesce(F.sum(F.when(F.col("start") <= at, F.col("duration"))), F.lit(0.0))
    return tasks.agg((upto(end) - upto(start)).alias("blocking_ms"))


def codec_stats(runs: DataFrame, metrics: list[str], by: str = "codec") -> DataFrame:
    """(codec, metric, n, mean, std, min, max) over runs without error; population deviation; values that are no numbers are left out."""
    long = runs.where("error IS NULL").select(by, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(`{m}` AS DOUBLE)").alias("v")) for m in metrics))))
    return long.where("v IS NOT NULL").groupBy(by, "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 2).alias("mean"), F.round(F.stddev_pop("v"), 2).alias("std"), F.round(F.min("v"), 2).alias("min"), F.round(F.max("v"), 2).alias("max")
    )


def progress(items: DataFrame) -> DataFrame:
    """Items done and in all."""
    return items.agg(F.count_if(F.col("done")).alias("done"), F.count("*").alias("total"))
