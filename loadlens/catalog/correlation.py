"""Queries of load x telemetry correlation.

The test tables space telemetry minutes apart, so most queries use 600 s and
every 20 users; ``nearest_join`` keeps the default 30 s.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.operators import correlate
from loadlens.sources.store import stored

_N, _TOL, _ORDER = 20, 600, ["datetime", "ord"]
_EMISSIONS = [m for m, _, _ in schemas.EMISSION_METRICS]


def _rounded(df):
    cols = [c for c in ("avg_error_rate", "avg_elapsed") if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in cols})


def every_n_users(spark, sf):
    return correlate.every_n_users(t.bins(spark, sf), _N).select("user_bin", "request_count")


def run_windows(spark, sf):
    return correlate.run_windows(t.saved_run_bins(spark, sf))


def within_window(spark, sf):
    bins = t.saved_run_bins(spark, sf)
    return correlate.within_window(bins, correlate.run_windows(bins)).select(
        "run_id", "user_bin", "bin_start_timestamp")


def assign_runs(spark, sf):
    windows = correlate.run_windows(t.saved_run_bins(spark, sf))
    host = t.host_metrics(spark, sf).drop("run_id")
    return correlate.assign_runs(host, windows, "datetime").select("run_id", "ord", "datetime")


def nearest_join(spark, sf):
    host = t.host_metrics(spark, sf)
    bins = t.saved_run_bins(spark, sf)
    found = correlate.nearest_join(bins, host, [F.col("ord").alias("host_ord")], "datetime", _ORDER)
    return found.select("run_id", "user_bin", "match.payload.host_ord")


def _host(spark, sf):
    return correlate.correlate_host(
        t.saved_run_bins(spark, sf), t.host_metrics(spark, sf), _ORDER, _TOL, _N)


def _emissions(spark, sf):
    return correlate.correlate_emissions(
        t.saved_run_bins(spark, sf), t.emissions(spark, sf), ["timestamp", "ord"], _TOL, _N)


def _phase2(spark, sf):
    return correlate.correlate_phase2(
        t.saved_bins(spark, sf), t.host_metrics(spark, sf), _ORDER, _TOL, _N)


def correlate_host(spark, sf):
    return _rounded(_host(spark, sf))


def correlate_emissions(spark, sf):
    return _emissions(spark, sf)


def correlate_phase2(spark, sf):
    return _rounded(_phase2(spark, sf)).withColumn(
        "cpu_cores_count", F.col("cpu_cores_count").cast("long"))


def unmatched_bins(spark, sf):
    bins = t.saved_bins(spark, sf)
    found = correlate.correlate_phase2(bins, t.host_metrics(spark, sf), _ORDER, _TOL, _N)
    return correlate.unmatched_bins(bins, found, n=_N).select("user_bin")


def concat_runs(spark, sf):
    return _rounded(correlate.concat_runs(stored(_host(spark, sf))))


def run_separators(spark, sf):
    df = correlate.run_separators(correlate.concat_runs(stored(_host(spark, sf))))
    return df.withColumn("label", F.col("label").cast("long"))


def correlation_series(spark, sf):
    df = correlate.correlation_series(
        correlate.concat_runs(stored(_host(spark, sf))), schemas.CORRELATED_HOST_METRICS)
    return df.withColumn("value", F.round("value", 6))


def emission_series(spark, sf):
    return correlate.correlation_series(correlate.concat_runs(stored(_emissions(spark, sf))), _EMISSIONS)


def drop_all_null_metrics(spark, sf):
    blank = F.lit(None).cast("double")
    df = correlate.concat_runs(stored(_host(spark, sf))).withColumn("gpu_util", blank)
    series = correlate.correlation_series(df, ["cpu_usage", "memory_percent", "gpu_util"])
    return correlate.drop_all_null_metrics(series).withColumn("value", F.round("value", 6))


def annotate_points(spark, sf):
    return correlate.annotate_points(stored(_phase2(spark, sf))).select(
        "user_bin", F.col("position").cast("long").alias("position"))


def correlation_summary(spark, sf):
    return correlate.correlation_summary(_phase2(spark, sf))


def bins_summary(spark, sf):
    return correlate.bins_summary(t.bins(spark, sf))


_WINDOWS = t.RUN_BINS_SQL + """,
windows AS (
  SELECT run_id, run_start, lead(run_start) OVER (ORDER BY run_id) - INTERVAL 5 MINUTE AS run_end
  FROM (SELECT run_id, arg_min(bin_start_timestamp, user_bin) AS run_start
        FROM bins GROUP BY run_id)),
kept AS (
  SELECT bins.*, run_start, run_end FROM bins JOIN windows USING (run_id)
  WHERE bin_start_timestamp >= run_start
    AND bin_start_timestamp <= coalesce(run_end, bin_start_timestamp))"""

_HOST_TABLE = t.HOST_SQL.removeprefix(t.EVENTS_SQL)
_EMIS_TABLE = t.EMISSIONS_SQL.removeprefix(t.EVENTS_SQL)


def _matched(source: str, ts: str) -> str:
    """All pairs within a run's period, then the nearest per bin."""
    return _WINDOWS + (_HOST_TABLE if source == "host" else _EMIS_TABLE) + f""",
matched AS (
  SELECT kept.run_id, user_bin, avg_error_rate, avg_elapsed, m.* EXCLUDE ({
      'ord, run_id' if source == 'host' else 'ord'})
  FROM kept, {source} m
  WHERE user_bin % {_N} = 0 AND m.{ts} >= run_start AND m.{ts} <= coalesce(run_end, m.{ts})
    AND abs(epoch_us(m.{ts}) - epoch_us(bin_start_timestamp)) <= {_TOL} * 1000000
  QUALIFY row_number() OVER (PARTITION BY kept.run_id, user_bin
    ORDER BY abs(epoch_us(m.{ts}) - epoch_us(bin_start_timestamp)), m.{ts}, m.ord) = 1)"""


_HOST_SQL = _matched("host", "datetime") + """,
correlated AS (
  SELECT run_id, user_bin, avg_error_rate, avg_elapsed, cpu_cores_sum AS cpu_usage,
         memory_percent, gpu_0_util_percent AS gpu_util, gpu_0_mem_used_mb AS gpu_mem
  FROM matched)"""
_EMISSIONS_SQL = _matched("emis", "timestamp") + f""",
correlated AS (SELECT run_id, user_bin, {', '.join(_EMISSIONS)} FROM matched)"""
_CONCAT = """,
offsets AS (
  SELECT run_id, CAST(coalesce(sum(top) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) AS BIGINT) AS run_offset
  FROM (SELECT run_id, max(user_bin) AS top FROM correlated GROUP BY run_id)),
joined AS (
  SELECT correlated.*, run_offset, user_bin + run_offset AS global_users
  FROM correlated JOIN offsets USING (run_id))"""

_PHASE2 = t.STATS_SQL + _HOST_TABLE + f""",
phase2 AS (
  SELECT user_bin, bin_start_timestamp, datetime AS system_timestamp,
         abs(epoch_us(datetime) - epoch_us(bin_start_timestamp)) / 1000000.0::DOUBLE
           AS time_diff_seconds,
         round(avg_error_rate, 6) AS avg_error_rate, round(avg_elapsed, 6) AS avg_elapsed,
         cpu_cores_sum AS cpu_usage, memory_percent, gpu_0_util_percent AS gpu_util_percent,
         gpu_0_mem_used_mb, CAST(2 AS BIGINT) AS cpu_cores_count
  FROM bins, host WHERE user_bin % {_N} = 0
    AND abs(epoch_us(datetime) - epoch_us(bin_start_timestamp)) <= {_TOL} * 1000000
  QUALIFY row_number() OVER (PARTITION BY user_bin
    ORDER BY abs(epoch_us(datetime) - epoch_us(bin_start_timestamp)), datetime, ord) = 1)"""


def _long_sql(metrics) -> str:
    return "\nUNION ALL ".join(
        f"SELECT run_id, global_users, '{m}' AS metric, round({m}, 6) AS value FROM joined"
        for m in metrics)


QUERIES = {
    "every_n_users": Query(every_n_users, f"""WITH {t.STATS_SQL}
SELECT user_bin, request_count FROM bins WHERE user_bin % {_N} = 0"""),
    "run_windows": Query(run_windows, f"WITH {_WINDOWS} SELECT * FROM windows"),
    "within_window": Query(within_window, f"""WITH {_WINDOWS}
SELECT run_id, user_bin, bin_start_timestamp FROM kept"""),
    "assign_runs": Query(assign_runs, f"""WITH {_WINDOWS} {_HOST_TABLE}
SELECT w.run_id, ord, datetime FROM host JOIN windows w
  ON datetime >= run_start AND datetime <= coalesce(run_end, datetime)"""),
    "nearest_join": Query(nearest_join, f"""WITH {t.RUN_BINS_SQL} {_HOST_TABLE}
SELECT bins.run_id, user_bin, host.ord AS host_ord FROM bins, host
WHERE abs(epoch_us(datetime) - epoch_us(bin_start_timestamp)) <= 30000000
QUALIFY row_number() OVER (PARTITION BY bins.run_id, user_bin
  ORDER BY abs(epoch_us(datetime) - epoch_us(bin_start_timestamp)), datetime, ord) = 1"""),
    "correlate_host": Query(correlate_host, f"""WITH {_HOST_SQL}
SELECT * REPLACE (round(avg_error_rate, 6) AS avg_error_rate, round(avg_elapsed, 6) AS avg_elapsed)
FROM correlated"""),
    "correlate_emissions": Query(
        correlate_emissions, f"WITH {_EMISSIONS_SQL} SELECT * FROM correlated"),
    "correlate_phase2": Query(correlate_phase2, f"""WITH {_PHASE2}
SELECT * RENAME (gpu_0_mem_used_mb AS gpu_mem_used_mb) FROM phase2"""),
    "unmatched_bins": Query(unmatched_bins, f"""WITH {_PHASE2}
SELECT user_bin FROM bins WHERE user_bin % {_N} = 0
  AND user_bin NOT IN (SELECT user_bin FROM phase2)"""),
    "concat_runs": Query(concat_runs, f"""WITH {_HOST_SQL} {_CONCAT}
SELECT * REPLACE (round(avg_error_rate, 6) AS avg_error_rate, round(avg_elapsed, 6) AS avg_elapsed)
FROM joined"""),
    "run_separators": Query(run_separators, f"""WITH {_HOST_SQL} {_CONCAT}
SELECT run_id, run_offset, row_number() OVER (ORDER BY run_id) - 1 AS label FROM offsets"""),
    "correlation_series": Query(
        correlation_series,
        f"WITH {_HOST_SQL} {_CONCAT} {_long_sql(schemas.CORRELATED_HOST_METRICS)}"),
    "emission_series": Query(
        emission_series, f"""WITH {_EMISSIONS_SQL} {_CONCAT}
""" + "\nUNION ALL ".join(
            f"SELECT run_id, global_users, '{m}' AS metric, {m} AS value FROM joined"
            for m in _EMISSIONS)),
    "drop_all_null_metrics": Query(
        drop_all_null_metrics,
        f"WITH {_HOST_SQL} {_CONCAT} {_long_sql(['cpu_usage', 'memory_percent'])}"),
    "annotate_points": Query(annotate_points, f"""WITH {_PHASE2}
SELECT user_bin, row_number() OVER (ORDER BY user_bin) - 1 AS position FROM phase2
QUALIFY position % greatest(1, count(*) OVER () // 5) = 0"""),
    "correlation_summary": Query(correlation_summary, f"""WITH {_PHASE2}
SELECT count(*) AS points, min(user_bin) AS user_bin_min, max(user_bin) AS user_bin_max,
       min(cpu_usage) AS cpu_usage_min, max(cpu_usage) AS cpu_usage_max,
       min(memory_percent) AS memory_percent_min, max(memory_percent) AS memory_percent_max,
       min(gpu_util_percent) AS gpu_util_percent_min, max(gpu_util_percent) AS gpu_util_percent_max
FROM phase2"""),
    "bins_summary": Query(bins_summary, f"""WITH {t.STATS_SQL}
SELECT count(*) AS bins, count(*) FILTER (WHERE user_bin % 100 = 0) AS kept_bins,
       min(user_bin) AS user_bin_min, max(user_bin) AS user_bin_max,
       min(bin_start_timestamp) AS first_time, max(bin_start_timestamp) AS last_time FROM bins"""),
}
