"""Structured Streaming versions of the live metrics.

Each ``run_*`` function starts a query that writes to a folder every executor can
reach and returns the query; output of a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loadlens.functions.numbers import floor_bin, micros, percent
from loadlens.sources.store import hadoop_path

def live_host_metrics(
    metrics: DataFrame, cols: Sequence[str], ts: str = "datetime", every: str = "1 minute",
    late: str = "2 minutes",
) -> DataFrame:
    """Mean and maximum of each metric per time window; rows later than ``late`` are dropped."""
    aggregates = [
        fn(c).alias(f"{c}_{which}") for c in cols
        for which, fn in (("avg", F.avg), ("max", F.max))
    ]
    return (
        metrics.withWatermark(ts, late)
        .groupBy(F.window(ts, every))
        .agg(F.count(F.lit(1)).alias("points"), *aggregates)
        .select(F.col("window.start").alias("window_start"), "points",
                *[f"{c}_{which}" for c in cols for which in ("avg", "max")])
    )


def live_user_bins(samples: DataFrame, width: int = 10) -> DataFrame:
    """Running request-weighted error rate and mean elapsed time per user bin (update mode)."""
    failed = F.count_if(~F.col("success"))
    return samples.groupBy(floor_bin(F.col("allthreads"), width).alias("user_bin")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        failed.alias("failed_requests"),
        percent(failed, F.count(F.lit(1))).alias("error_rate"),
        F.avg("elapsed").alias("avg_elapsed"),
        F.min("timestamp").alias("bin_start_timestamp"),
    )


# State of transformWithState lives in RocksDB; changes are written, not whole tables.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for streaming queries, with state in ``state_partitions`` partitions.

    By default one per core.  A query keeps the number it first started with, so choose it for
    the load to come.  Read the stream with this session; others keep their settings.
    """
    child = spark.newSession()
    child.conf.set("spark.sql.shuffle.partitions",
                   str(state_partitions or spark.sparkContext.defaultParallelism))
    child.conf.set("spark.sql.session.timeZone", "UTC")
    return child


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Settings a query takes over when it starts; the session's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in _STATE_STORE}
    for key, value in _STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _start(df: DataFrame, mode: str, folder: str, write, once: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _append(df: DataFrame, folder: str, name: str, once: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/{name}")
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_append(df: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Append finished rows to Parquet under ``folder``/rows."""
    return _append(df, folder, "rows", once)


def _written(spark: SparkSession, path: str) -> list[int]:
    """The batches whose table under ``path`` is whole, in order."""
    fs, folder = hadoop_path(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    found = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [b for b in found if fs.exists(hadoop_path(spark, f"{path}/batch={b}/_SUCCESS")[1])]


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the table as it is after ``batch_id``; only the one before it is kept beside it."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for older in [b for b in _written(spark, path) if b < batch_id][:-1]:
        fs, folder = hadoop_path(spark, f"{path}/batch={older}")
        fs.delete(folder, True)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest table under ``path``."""
    batches = _written(spark, path)
    if not batches:
        raise ValueError(f"nothing was written to {path}")
    return spark.read.parquet(f"{path}/batch={batches[-1]}")


_LEVEL = "total long, failed long, elapsed double, first long"
# Groups a task holds before it hands on what it has added up.
_HELD = 100_000


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of a task as one row for each bin and level."""
    keys = ["user_bin", "level"]
    sums = [("total", "sum"), ("failed", "sum"), ("elapsed", "sum"), ("first", "min")]
    held = None
    for batch in batches:
        # Without the marks of columns that are never missing, which sums do not carry.
        rows = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        both = rows if held is None else pa.concat_tables([held, rows])
        held = both.group_by(keys).aggregate(sums)
        held = held.rename_columns(
            [c.rsplit("_", 1)[0] if c not in keys else c for c in held.column_names]
        ).select(rows.column_names)
        if held.num_rows > _HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def _partial_levels(samples: DataFrame, width: int) -> DataFrame:
    """(user_bin, level, total, failed, elapsed, first), added up in each task.

    A hot bin thus reaches its state as one row for each task and level.
    """
    return samples.select(
        floor_bin(F.col("allthreads"), width).alias("user_bin"),
        F.col("allthreads").cast("double").alias("level"),
        F.lit(1).cast("long").alias("total"),
        F.when(F.col("success"), 0).otherwise(1).cast("long").alias("failed"),
        F.col("elapsed").cast("double").alias("elapsed"),
        micros("timestamp").alias("first"),
    ).mapInArrow(_added_up, f"user_bin long, level double, {_LEVEL}")


def _by_level(rows: Iterable[Row]) -> dict[float, tuple[int, int, float, int]]:
    levels: dict[float, tuple[int, int, float, int]] = {}
    for r in rows:
        n, failed, elapsed, first = levels.get(r.level, (0, 0, 0.0, r.first))
        levels[r.level] = (n + r.total, failed + r.failed, elapsed + r.elapsed,
                           min(first, r.first))
    return levels


class _BinOfLevels(StatefulProcessor):
    """Keeps a bin's levels, a bounded number, and emits the bin whenever one of them changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "level double", _LEVEL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {k[0]: tuple(v) for k, v in self.levels.iterator()}
        for level, (n, failed, elapsed, first) in _by_level(rows).items():
            if level in known:
                m, bad, spent, since = known[level]
                n, failed, elapsed, first = (
                    n + m, failed + bad, elapsed + spent, min(first, since))
            known[level] = (n, failed, elapsed, first)
            self.levels.updateValue((level,), known[level])
        count = len(known)
        yield Row(
            user_bin=key[0],
            avg_error_rate=sum(100.0 * bad / n for n, bad, _, _ in known.values()) / count,
            avg_elapsed=sum(spent / n for n, _, spent, _ in known.values()) / count,
            request_count=count, first=min(since for _, _, _, since in known.values()))

    def close(self) -> None:
        pass


class _AlertOnce(StatefulProcessor):
    """Keeps a bin's totals and whether it was reported; emits it once, when its rate passes."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bin = handle.getValueState("bin", "total long, failed long, raised boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, bad, raised = self.bin.get() if self.bin.exists() else (0, 0, False)
        for r in rows:
            n, bad = n + r.total, bad + r.failed
        rate = 100.0 * bad / n
        passed = not raised and rate > self.threshold
        self.bin.update((n, bad, raised or passed))
        if passed:
            yield Row(user_bin=key[0], total_requests=n, failed_requests=bad, error_rate=rate)

    def close(self) -> None:
        pass


def run_user_bins(
    samples: DataFrame, folder: str, width: int = 10, once: bool = True
) -> StreamingQuery:
    """Keep the user bins of :func:`capacity.user_bins` current under ``folder``/bins.

    The state holds a map of concurrency levels for each bin; a batch touches the levels it has
    samples of and hands on the bins it changed, one row each, which take the place of their
    earlier rows.  Read the result with :func:`latest_batch`.
    """
    path = f"{folder}/bins"

    def store(changed: DataFrame, batch_id: int) -> None:
        session = changed.sparkSession
        # Used twice below; without it the batch would run twice.
        new = changed.withColumn(
            "bin_start_timestamp", F.timestamp_micros("first")).drop("first").persist()
        rows, before = new, [b for b in _written(session, path) if b < batch_id]
        if before:
            known = session.read.schema(new.schema).parquet(f"{path}/batch={before[-1]}")
            rows = new.unionByName(known.join(new.select("user_bin"), "user_bin", "left_anti"))
        _replace(rows.coalesce(1), path, batch_id)  # one row for each bin
        new.unpersist()

    bins = _partial_levels(samples, width).groupBy("user_bin").transformWithState(
        _BinOfLevels(), "user_bin long, avg_error_rate double, avg_elapsed double, "
        "request_count long, first long", "Update", "None")
    with _state_store(samples.sparkSession):
        return _start(bins, "update", folder, store, once)


_ALERT = "user_bin long, total_requests long, failed_requests long, error_rate double"


def run_saturation_alerts(
    samples: DataFrame, folder: str, threshold: float = 5.0, width: int = 10, once: bool = True
) -> StreamingQuery:
    """Append one alert per bin whose running error rate passed ``threshold`` to ``folder``/alerts.

    The state of a bin tells whether it was reported, so an alert is written once however many
    batches, or restarts of the query, follow; it has the bin's totals at the end of the batch
    that raised it.  Read the alerts with :func:`raised_alerts`.
    """
    alerts = _partial_levels(samples, width).groupBy("user_bin").transformWithState(
        _AlertOnce(threshold), _ALERT, "Append", "None")
    with _state_store(samples.sparkSession):
        return _append(alerts, folder, "alerts", once)


def raised_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts raised so far below ``folder``."""
    return spark.read.schema(_ALERT).parquet(f"{folder}/alerts")


def live_dedup(
    spans: DataFrame, ts: str = "start_time", late: str = "10 minutes",
    row_id: Sequence[str] = ("`context.span_id`",), salts: int = 16,
) -> DataFrame:
    """First span of each question as it arrives; repeats within ``late`` are dropped.

    Rows are first thinned out per question and salt, so a question with many
    repeats is spread over ``salts`` tasks before its survivors meet in one; take about as many
    as the cluster has cores.
    Unlike ``mark_duplicates`` it forgets questions older than the watermark.
    """
    salted = spans.withWatermark(ts, late).withColumn(
        "_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)))
    return (
        salted.dropDuplicatesWithinWatermark(["question", "_salt"])
        .dropDuplicatesWithinWatermark(["question"])
        .drop("_salt")
    )
