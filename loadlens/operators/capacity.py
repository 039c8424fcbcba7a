"""Load-test capacity: error rate and latency by concurrency, and the saturation point.

``by`` names columns, such as ``run_id``, that tell load tests apart; without it
the table is one test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.functions.numbers import epoch_ms_to_timestamp, floor_bin, percent, to_number

_NUMERIC = ("timestamp", "elapsed", "latency", "allthreads")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Sample columns in lower case; other columns keep their names."""
    return df.withColumnsRenamed({n: n.lower() for n in schemas.SAMPLE_COLUMNS})


def filter_label(df: DataFrame, label: str = schemas.HTTP_SAMPLER) -> DataFrame:
    """Samples of one sampler."""
    return df.filter(F.col("label") == label)


def clean_numeric(df: DataFrame, cols: Sequence[str] = _NUMERIC) -> DataFrame:
    """Turn ``cols`` into numbers and drop rows where any of them is missing."""
    return df.withColumns({c: to_number(df, c) for c in cols}).dropna(subset=list(cols))


def derive_sample_fields(df: DataFrame) -> DataFrame:
    """Timestamp from epoch milliseconds, success as a boolean (missing is false)."""
    return df.withColumns({
        "timestamp": epoch_ms_to_timestamp(F.col("timestamp")),
        "success": F.coalesce(F.lower(F.col("success").cast("string")) == "true", F.lit(False)),
    })


def prepare_samples(raw: DataFrame, label: str = schemas.HTTP_SAMPLER) -> DataFrame:
    """Raw samples to the clean rows every statistic starts from."""
    return derive_sample_fields(clean_numeric(filter_label(normalise_columns(raw), label)))


def thread_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, failures, error rate and mean elapsed time per concurrency level."""
    failed = F.count_if(~F.col("success"))
    return df.groupBy(*by, "allthreads").agg(
        F.count("success").alias("total_requests"),
        failed.alias("failed_requests"),
        percent(failed, F.count(F.lit(1))).alias("error_rate"),
        F.avg("elapsed").alias("avg_elapsed"),
        F.min("timestamp").alias("first_timestamp"),
    )


def user_bin(col: Column, width: int) -> Column:
    """Lower edge of the bin of concurrent users."""
    return floor_bin(col, width)


def bin_start_times(df: DataFrame, width: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """First sample time of each user bin."""
    return df.groupBy(*by, user_bin(F.col("allthreads"), width).alias("user_bin")).agg(
        F.min("timestamp").alias("bin_start_timestamp"))


def bin_stats(
    stats: DataFrame, width: int = 10, by: Sequence[str] = (), weighted: bool = False
) -> DataFrame:
    """Thread statistics per user bin.

    By default the plain mean over concurrency levels; ``request_count`` is the
    number of levels.  ``weighted`` weighs each level by its requests.
    """
    if weighted:
        n = F.sum("total_requests")
        rate = percent(F.sum("failed_requests"), n)
        elapsed = F.sum(F.col("avg_elapsed") * F.col("total_requests")) / n
    else:
        rate, elapsed = F.avg("error_rate"), F.avg("avg_elapsed")
    return stats.groupBy(*by, user_bin(F.col("allthreads"), width).alias("user_bin")).agg(
        rate.alias("avg_error_rate"),
        elapsed.alias("avg_elapsed"),
        F.count("error_rate").alias("request_count"),
        F.min("first_timestamp").alias("bin_start_timestamp"),
    )


def user_bins(
    df: DataFrame, width: int = 10, by: Sequence[str] = (), weighted: bool = False
) -> DataFrame:
    """User bins with their start times, from clean samples.

    The start time rides along through both aggregations, so samples are shuffled
    once, already reduced to one row per concurrency level and task.
    """
    return bin_stats(thread_stats(df, by), width, by, weighted).select(
        *by, "user_bin", "bin_start_timestamp", "avg_error_rate", "avg_elapsed", "request_count")


def nmax(bins: DataFrame, threshold: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Smallest bin whose error rate is above ``threshold``, else the largest bin.

    Without bins the answer is NULL.
    """
    breaking = F.when(F.col("avg_error_rate") > threshold, F.col("user_bin"))
    return bins.groupBy(*by).agg(F.coalesce(F.min(breaking), F.max("user_bin")).alias("nmax"))


def error_rate_series(bins: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Error rate by users with the saturation point on each row."""
    return bins.select(
        F.col("user_bin").alias("x"), F.col("avg_error_rate").alias("y"),
        nmax(bins, threshold).scalar().alias("nmax"))


def elapsed_series(bins: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Mean elapsed minutes by users with the saturation point on each row."""
    return bins.select(
        F.col("user_bin").alias("x"), (F.col("avg_elapsed") / 60000).alias("y"),
        nmax(bins, threshold).scalar().alias("nmax"))


def assert_response_code(df: DataFrame, pattern: str = "200") -> DataFrame:
    """Mark samples as passed when the response code contains a match of ``pattern``."""
    passed = F.coalesce(F.col("responsecode").rlike(pattern), F.lit(False))
    message = F.concat(
        F.lit("Test failed: code expected to contain /"), F.lit(pattern), F.lit("/"))
    return df.withColumns({
        "success": passed, "failuremessage": F.when(passed, F.lit("")).otherwise(message)})
