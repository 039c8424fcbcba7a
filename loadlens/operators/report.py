"""Run report: statistics per sampler, errors, and series over time.

Percentiles are exact.  Samples are first counted per elapsed time, which
combines map-side and is bounded by the response timeout in milliseconds, so a
label that holds most samples reaches its final task as a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.numbers import micros, percent

_QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
TOTAL = "Total"


def _elapsed_stats() -> list[Column]:
    points = [
        F.percentile("elapsed", F.lit(q), F.col("n")).alias(name)
        for name, q in _QUANTILES.items()
    ]
    return [
        (F.sum(F.col("elapsed") * F.col("n")) / F.sum("n")).alias("mean_elapsed"),
        F.min("elapsed").alias("min_elapsed"),
        F.max("elapsed").alias("max_elapsed"),
        *points,
    ]


def report_summary(df: DataFrame) -> DataFrame:
    """Per label and in total: samples, errors, elapsed statistics and throughput.

    ``df`` holds clean samples (timestamp, elapsed in ms, label, success, bytes, sentbytes).
    """
    counted = df.groupBy("label", "elapsed").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("bytes").alias("bytes"),
        F.sum("sentbytes").alias("sentbytes"),
        F.min(micros("timestamp")).alias("first_us"),
        F.max(micros("timestamp") + F.col("elapsed") * 1000).alias("last_us"),
    )
    seconds = F.nullif((F.max("last_us") - F.min("first_us")) / 1e6, F.lit(0.0))
    return counted.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        F.sum("n").alias("samples"),
        F.sum("failed").alias("failures"),
        percent(F.sum("failed"), F.sum("n")).alias("error_pct"),
        *_elapsed_stats(),
        (F.sum("n") / seconds).alias("throughput_per_sec"),
        (F.sum("bytes") / 1024 / seconds).alias("received_kb_per_sec"),
        (F.sum("sentbytes") / 1024 / seconds).alias("sent_kb_per_sec"),
    ).withColumn(
        "label", F.when(F.col("is_total") == 1, F.lit(TOTAL)).otherwise(F.col("label"))
    ).drop("is_total")


def report_errors(df: DataFrame) -> DataFrame:
    """Errors by response code and message, with shares of all errors and all samples."""
    totals = df.agg(F.struct(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~F.col("success")).alias("errors"),
    ).alias("t")).scalar()
    return (
        df.filter(~F.col("success"))
        .groupBy("responsecode", "responsemessage")
        .agg(F.count(F.lit(1)).alias("errors"))
        .withColumn("t", totals)
        .select(
            "responsecode", "responsemessage", "errors",
            percent(F.col("errors"), F.col("t.errors")).alias("pct_of_errors"),
            percent(F.col("errors"), F.col("t.samples")).alias("pct_of_samples"))
    )


def report_top_errors(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent errors of each sampler."""
    counted = (
        df.filter(~F.col("success"))
        .groupBy("label", "responsecode", "responsemessage")
        .agg(F.count(F.lit(1)).alias("errors"))
    )
    rank = Window.partitionBy("label").orderBy(
        F.desc("errors"), "responsecode", "responsemessage")
    return counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def report_over_time(df: DataFrame, every: str = "1 minute") -> DataFrame:
    """Per time slice: samples, active users, throughput and elapsed statistics."""
    counted = df.groupBy(F.window("timestamp", every), "elapsed").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.max("allthreads").alias("users"),
    )
    seconds = F.max(F.unix_seconds("window.end") - F.unix_seconds("window.start"))
    return counted.groupBy("window").agg(
        F.sum("n").alias("samples"),
        F.sum("failed").alias("failures"),
        F.max("users").alias("active_users"),
        (F.sum("n") / seconds).alias("throughput_per_sec"),
        *_elapsed_stats(),
    ).withColumn("window_start", F.col("window.start")).drop("window")


def codes_over_time(df: DataFrame, every: str = "1 minute") -> DataFrame:
    """Per time slice and response code: responses and responses per second."""
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return (
        df.groupBy(F.window("timestamp", every), "responsecode")
        .agg(F.count(F.lit(1)).alias("responses"))
        .withColumn("per_sec", F.col("responses") / seconds)
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )


def run_file_summary(scan: DataFrame) -> DataFrame:
    """Rows and bytes per file of a file scan."""
    return (
        scan.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("lines"), F.max("_metadata.file_size").alias("bytes"))
    )


def run_summary(samples: DataFrame, by: str = "run_id") -> DataFrame:
    """Rows per run."""
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("lines"))


# Size of a quantile sketch.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Error of the rank of a sketched percentile, as a share of the rows.

    It holds for 99 of 100 percentiles, and twice of it for all but one in a million, however
    often sketches of this ``k`` are put together.
    """
    return 2.296 / k ** 0.9723


def elapsed_sketches(df: DataFrame, every: str = "1 minute", by: Sequence[str] = (),
                     k: int = SKETCH_K) -> DataFrame:
    """Per time slice: samples, failures and a mergeable sketch of the elapsed milliseconds.

    A sketch has a few kilobytes whatever the number of samples, so slices can be kept and rolled
    up later without the samples.
    """
    return df.groupBy(*by, F.window("timestamp", every).alias("window")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~F.col("success")).alias("failures"),
        F.kll_sketch_agg_bigint(F.col("elapsed").cast("long"), k).alias("elapsed_sketch"),
    ).withColumn("window_start", F.col("window.start")).drop("window")


def roll_up(sketches: DataFrame, every: str | None = None, by: Sequence[str] = (),
            k: int = SKETCH_K) -> DataFrame:
    """Sketched slices put together: longer slices with ``every``, else all of each ``by``."""
    groups = [*by]
    if every is not None:
        groups.append(F.window("window_start", every)["start"].alias("window_start"))
    return sketches.groupBy(*groups).agg(
        F.sum("samples").alias("samples"), F.sum("failures").alias("failures"),
        F.kll_merge_agg_bigint("elapsed_sketch", k).alias("elapsed_sketch"))


def sketched_percentiles(rolled: DataFrame, ranks: Sequence[float] = (0.5, 0.9, 0.95, 0.99)
                         ) -> DataFrame:
    """Add the elapsed percentiles ``p50``, ``p90`` and so on, within :func:`rank_error`."""
    return rolled.withColumns({
        f"p{100 * r:g}".replace(".", "_"): F.kll_sketch_get_quantile_bigint(
            "elapsed_sketch", F.lit(r)) for r in ranks}).drop("elapsed_sketch")
