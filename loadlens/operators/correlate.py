"""Load x telemetry correlation: what the host did when load reached N users, over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.functions.numbers import micros
from loadlens.operators.telemetry import cores_sum, core_columns, file_order, unpivot_metrics
from loadlens.plans.nearest import nearest_match

TOLERANCE = 30
_BIN_TS = "bin_start_timestamp"


def every_n_users(bins: DataFrame, n: int = 100) -> DataFrame:
    """Bins at multiples of ``n`` users."""
    return bins.filter(F.col("user_bin") % n == 0)


def run_windows(
    bins: DataFrame, gap_seconds: int = 300, order_by: str | None = None
) -> DataFrame:
    """Period of each run: from its first row to ``gap_seconds`` before the next run starts.

    Takes the bins before :func:`every_n_users`.  The first row is that of the run file if the
    bins were read from one, unless ``order_by`` says otherwise.  The last run has no end.
    """
    order_by = order_by or file_order(bins)
    starts = bins.groupBy("run_id").agg(F.min_by(_BIN_TS, order_by).alias("run_start"))
    following = F.lead("run_start").over(Window.orderBy("run_id"))  # one row per run
    return starts.withColumn(
        "run_end", F.timestamp_micros(micros(following) - gap_seconds * 1_000_000))


def _inside(ts: Column) -> Column:
    return (ts >= F.col("run_start")) & F.coalesce(ts <= F.col("run_end"), F.lit(True))


def within_window(bins: DataFrame, windows: DataFrame, ts: str = _BIN_TS) -> DataFrame:
    """Rows of each run inside the run's period, both ends included."""
    return bins.join(windows, "run_id").filter(_inside(F.col(ts)))


def assign_runs(
    df: DataFrame, windows: DataFrame, ts: str, slice_seconds: int = 86_400
) -> DataFrame:
    """Give rows without a run the run whose period holds them; other rows are dropped.

    Periods are cut into time slices and joined by slice, so no row meets a run of
    another day.  An open period ends with the data.
    """
    def start_of(us: Column) -> Column:
        return us - F.pmod(us, F.lit(slice_seconds * 1_000_000))

    last = df.agg(F.max(micros(ts)).alias("us")).scalar()
    spans = (
        windows.withColumn("_from", start_of(micros("run_start")))
        .withColumn("_to", start_of(F.least(micros("run_end"), last)))
        .filter("_from <= _to")
        .withColumn("_slice", F.explode(
            F.sequence("_from", "_to", F.lit(slice_seconds * 1_000_000))))
        .drop("_from", "_to")
    )
    return (
        df.withColumn("_slice", start_of(micros(ts)))
        .join(spans, "_slice").filter(_inside(F.col(ts))).drop("_slice")
    )


def nearest_join(
    bins: DataFrame, metrics: DataFrame, payload: Sequence[Column], metric_ts: str,
    order_by: Sequence[str], tolerance: float = TOLERANCE, windows: DataFrame | None = None,
) -> DataFrame:
    """Bins with the metric row nearest in time, within ``tolerance`` seconds.

    With ``windows`` both sides stay inside the period of the bin's run.  Periods
    apply to the two candidates of each bin, so metrics need no run of their own.
    """
    start = end = None
    if windows is not None:
        bins = within_window(bins, windows)
        start, end = F.col("run_start"), F.col("run_end")
    found = nearest_match(
        bins, metrics, _BIN_TS, metric_ts, list(order_by), list(payload), tolerance, start, end)
    return found.drop("run_start", "run_end")


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def correlate_host(
    bins: DataFrame, metrics: DataFrame, order_by: Sequence[str], tolerance: float = TOLERANCE,
    n: int = 100, gap_seconds: int = 300, ts: str = "datetime", bins_order: str | None = None,
) -> DataFrame:
    """Host usage at every ``n`` users of each run; ``bins_order`` as in :func:`run_windows`."""
    payload = [
        cores_sum(metrics, F.lit(None).cast("double")).alias("cpu_usage"),
        _optional(metrics, "memory_percent").alias("memory_percent"),
        _optional(metrics, "gpu_0_util_percent").alias("gpu_util"),
        _optional(metrics, "gpu_0_mem_used_mb").alias("gpu_mem"),
    ]
    found = nearest_join(every_n_users(bins, n), metrics, payload, ts, order_by, tolerance,
                         run_windows(bins, gap_seconds, bins_order))
    return found.select(
        "run_id", "user_bin", "avg_error_rate", "avg_elapsed", "match.payload.*")


def correlate_emissions(
    bins: DataFrame, emissions: DataFrame, order_by: Sequence[str], tolerance: float = TOLERANCE,
    n: int = 100, gap_seconds: int = 300, ts: str = "timestamp", bins_order: str | None = None,
) -> DataFrame:
    """Power and energy at every ``n`` users of each run; ``bins_order`` as in :func:`run_windows`."""
    payload = [_optional(emissions, m).alias(m) for m, _, _ in schemas.EMISSION_METRICS]
    found = nearest_join(every_n_users(bins, n), emissions, payload, ts, order_by, tolerance,
                         run_windows(bins, gap_seconds, bins_order))
    return found.select("run_id", "user_bin", "match.payload.*")


def correlate_phase2(
    bins: DataFrame, metrics: DataFrame, order_by: Sequence[str], tolerance: float = TOLERANCE,
    n: int = 100, ts: str = "datetime",
) -> DataFrame:
    """Host usage at every ``n`` users of one search run, with both times and their distance."""
    payload = [
        cores_sum(metrics, F.lit(0.0)).alias("cpu_usage"),
        _optional(metrics, "memory_percent").alias("memory_percent"),
        _optional(metrics, "gpu_0_util_percent").alias("gpu_util_percent"),
        _optional(metrics, "gpu_0_mem_used_mb").alias("gpu_mem_used_mb"),
    ]
    found = nearest_join(every_n_users(bins, n), metrics, payload, ts, order_by, tolerance)
    gap = F.abs(F.col("match.us") - micros(_BIN_TS)) / 1e6
    return found.select(
        "user_bin", _BIN_TS, F.timestamp_micros("match.us").alias("system_timestamp"),
        gap.alias("time_diff_seconds"), "avg_error_rate", "avg_elapsed", "match.payload.*",
        F.lit(len(core_columns(metrics)) or 1).alias("cpu_cores_count"))


def unmatched_bins(
    bins: DataFrame, correlated: DataFrame, keys: Sequence[str] = ("user_bin",), n: int = 100
) -> DataFrame:
    """Bins at multiples of ``n`` users that found no metric row."""
    return every_n_users(bins, n).join(correlated, list(keys), "left_anti")


def concat_runs(correlated: DataFrame) -> DataFrame:
    """Lay runs end to end: ``global_users`` is the bin plus the tops of earlier runs."""
    tops = correlated.groupBy("run_id").agg(F.max("user_bin").alias("top"))
    earlier = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(
        "run_id", F.coalesce(F.sum("top").over(earlier), F.lit(0)).alias("run_offset"))
    return correlated.join(offsets, "run_id").withColumn(
        "global_users", F.col("user_bin") + F.col("run_offset"))


def run_separators(concatenated: DataFrame) -> DataFrame:
    """Start of each run with rows on the concatenated axis, labelled 0, 1, 2 ..."""
    runs = concatenated.groupBy("run_id").agg(F.max("run_offset").alias("run_offset"))
    return runs.withColumn("label", F.row_number().over(Window.orderBy("run_id")) - 1)


def correlation_series(concatenated: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long chart table over the concatenated axis, one row per point and metric."""
    return unpivot_metrics(concatenated, ["run_id", "global_users"], metrics)


def drop_all_null_metrics(series: DataFrame) -> DataFrame:
    """Chart table without metrics that have no value at all."""
    present = series.groupBy("metric").agg(F.count("value").alias("n")).filter("n > 0")
    return series.join(present, "metric", "left_semi")


def annotate_points(
    correlated: DataFrame, order_by: Sequence[str] = ("user_bin",), labels: int = 5
) -> DataFrame:
    """Every (rows div ``labels``)-th row, at least every row.

    The table holds one row per kept user bin, so one task orders it.
    """
    placed = correlated.withColumns({
        "position": F.row_number().over(Window.orderBy(*order_by)) - 1,
        "_total": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / labels))
    return placed.filter(F.col("position") % step == 0).drop("_total")


def correlation_summary(correlated: DataFrame) -> DataFrame:
    """Number of points and ranges of users, CPU, memory and GPU."""
    cols = [c for c in ("user_bin", "cpu_usage", "memory_percent", "gpu_util_percent", "gpu_util")
            if c in correlated.columns]
    return correlated.agg(
        F.count(F.lit(1)).alias("points"),
        *[fn(c).alias(f"{c}_{which}") for c in cols
          for which, fn in (("min", F.min), ("max", F.max))])


def bins_summary(bins: DataFrame, n: int = 100) -> DataFrame:
    """Bins before and after :func:`every_n_users`, user range and time range."""
    return bins.agg(
        F.count(F.lit(1)).alias("bins"),
        F.count_if(F.col("user_bin") % n == 0).alias("kept_bins"),
        F.min("user_bin").alias("user_bin_min"), F.max("user_bin").alias("user_bin_max"),
        F.min(_BIN_TS).alias("first_time"), F.max(_BIN_TS).alias("last_time"))
