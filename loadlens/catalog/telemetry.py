"""Queries of telemetry shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.functions.columns import require_columns
from loadlens.operators import telemetry

_ORDER = ["datetime", "ord"]


def with_time(spark, sf):
    return t.host_metrics(spark, sf).select("ord", "timestamp", "datetime", "time_str")


def cpu_cores_sum(spark, sf):
    return t.host_metrics(spark, sf).select("ord", "cpu_cores_sum")


def cores_fallback(spark, sf):
    """Hosts that report no core: the total stands in, or nothing at all."""
    bare = t.host_metrics(spark, sf).drop("cpu_cores_sum", "cpu_0_percent", "cpu_1_percent")
    total = telemetry.cpu_cores_sum(bare).withColumnRenamed("cpu_cores_sum", "from_total")
    return telemetry.cpu_cores_sum(total.drop("cpu_percent_total")).select(
        "ord", "from_total", F.col("cpu_cores_sum").alias("from_nothing"))


def with_capacity(spark, sf):
    caps = ["cpu_cores_count", "cpu_max_possible", "memory_max_percent", "gpu_max_util_percent"]
    df = telemetry.with_capacity(t.host_metrics(spark, sf))
    return df.select("ord", *[F.col(c).cast("long").alias(c) for c in caps])


def moving_average(spark, sf):
    # Positions are written out, so only the columns in use go in.
    host = t.host_metrics(spark, sf).select(
        "run_id", "ord", "datetime", "cpu_cores_sum", "cpu_1_percent")
    df = telemetry.moving_average(
        host, ["cpu_cores_sum", "cpu_1_percent"], _ORDER, ["run_id"])
    return df.select("run_id", "ord", F.round("cpu_cores_sum_ma", 6).alias("cpu_cores_sum_ma"),
                     F.round("cpu_1_percent_ma", 6).alias("cpu_1_percent_ma"))


def run_starts(spark, sf):
    return telemetry.run_starts(t.run_bins(spark, sf))


_STARTS_SQL = """
starts AS (
  SELECT run_id, coalesce(min(bin_start_timestamp) FILTER (WHERE user_bin = 0),
                          arg_min(bin_start_timestamp, user_bin)) AS run_start
  FROM bins GROUP BY run_id)"""


def snap_run_starts(spark, sf):
    starts = telemetry.run_starts(t.saved_run_bins(spark, sf))
    return telemetry.snap_run_starts(starts, t.host_metrics(spark, sf))


def metric_series(spark, sf):
    starts = telemetry.run_starts(t.saved_run_bins(spark, sf))
    df = telemetry.metric_series(t.emissions(spark, sf), starts, "timestamp")
    return df.withColumn("run_id", F.col("run_id").cast("long"))


def host_metric_series(spark, sf):
    host = t.host_metrics(spark, sf)
    starts = telemetry.snap_run_starts(telemetry.run_starts(t.saved_run_bins(spark, sf)), host)
    df = telemetry.metric_series(host, starts, "datetime", "marker", schemas.HOST_METRICS)
    return df.withColumn("run_id", F.col("run_id").cast("long"))


def _series_sql(source: str, ts: str, catalogue, markers: str) -> str:
    rows = "\n  UNION ALL ".join(
        f"SELECT 'series' AS kind, {ts} AS at, '{c}' AS metric, '{title}' AS title, "
        f"'{unit}' AS unit, {c} AS value, CAST(NULL AS BIGINT) AS run_id FROM {source}"
        for c, title, unit in catalogue)
    return f"""{rows}
  UNION ALL SELECT 'run_start', {markers}, NULL, NULL, NULL, NULL, run_id FROM starts"""


_HOST_AFTER_SAMPLES = t.HOST_SQL.removeprefix(t.EVENTS_SQL)
_EMIS_AFTER_SAMPLES = t.EMISSIONS_SQL.removeprefix(t.EVENTS_SQL)
_SNAP = "coalesce((SELECT min(datetime) FROM host WHERE datetime >= run_start), run_start)"


def telemetry_summary(spark, sf):
    return telemetry.telemetry_summary(t.host_metrics(spark, sf))


def sample_ticks(spark, sf):
    host = t.host_metrics(spark, sf).select("ord", "datetime", "time_str")
    return telemetry.sample_ticks(host, _ORDER).drop("datetime")


def required_columns(spark, sf):
    """Values by wanted column, and what the strict check says of those the table lacks."""
    host = t.host_metrics(spark, sf)
    wanted = [*schemas.HOST_REQUIRED, "battery_percent", "fan_rpm"]
    missing = require_columns(host, wanted, strict=False)
    try:
        require_columns(host, wanted)
        said = None
    except ValueError as error:
        said = str(error)
    found = [c for c in wanted if c not in missing]
    counts = host.agg(*[F.count(c).alias(c) for c in found]).unpivot(
        [], found, "column", "n_values").withColumn("error", F.lit(None).cast("string"))
    lacking = host.agg(F.count(F.lit(1)).alias("_rows")).select(
        F.explode(F.array(*[F.lit(m) for m in missing])).alias("column"),
        F.lit(0).cast("long").alias("n_values"), F.lit(said).alias("error"))
    return counts.unionByName(lacking)


QUERIES = {
    "required_columns": Query(required_columns, f"""WITH {t.HOST_SQL}
SELECT 'timestamp' AS "column", count(timestamp) AS n_values, CAST(NULL AS VARCHAR) AS error FROM host
UNION ALL SELECT 'memory_percent', count(memory_percent), NULL FROM host
UNION ALL SELECT 'gpu_0_util_percent', count(gpu_0_util_percent), NULL FROM host
UNION ALL SELECT 'gpu_0_mem_used_mb', count(gpu_0_mem_used_mb), NULL FROM host
UNION ALL SELECT c, 0, 'missing columns: battery_percent, fan_rpm'
FROM (VALUES ('battery_percent'), ('fan_rpm')) v(c)"""),
    "with_time": Query(with_time, f"""WITH {t.HOST_SQL}
SELECT ord, timestamp, datetime, strftime(datetime, '%H:%M:%S') AS time_str FROM host"""),
    "cpu_cores_sum": Query(cpu_cores_sum, f"WITH {t.HOST_SQL} SELECT ord, cpu_cores_sum FROM host"),
    "cores_fallback": Query(cores_fallback, f"""WITH {t.HOST_SQL}
SELECT ord, cpu_percent_total AS from_total, CAST(0 AS DOUBLE) AS from_nothing FROM host"""),
    "with_capacity": Query(with_capacity, f"""WITH {t.HOST_SQL}
SELECT ord, CAST(2 AS BIGINT) AS cpu_cores_count, CAST(200 AS BIGINT) AS cpu_max_possible,
       CAST(100 AS BIGINT) AS memory_max_percent, CAST(100 AS BIGINT) AS gpu_max_util_percent
FROM host"""),
    "moving_average": Query(moving_average, f"""WITH {t.HOST_SQL}
SELECT run_id, ord, round(avg(cpu_cores_sum) OVER w, 6) AS cpu_cores_sum_ma,
       round(avg(cpu_1_percent) OVER w, 6) AS cpu_1_percent_ma
FROM host WINDOW w AS (PARTITION BY run_id ORDER BY datetime, ord
                       ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""),
    "run_starts": Query(
        run_starts, f"WITH {t.RUN_BINS_SQL}, {_STARTS_SQL} SELECT * FROM starts"),
    "snap_run_starts": Query(snap_run_starts, f"""
WITH {t.RUN_BINS_SQL} {_HOST_AFTER_SAMPLES}, {_STARTS_SQL}
SELECT run_id, run_start, {_SNAP} AS marker FROM starts"""),
    "metric_series": Query(metric_series, f"""
WITH {t.RUN_BINS_SQL} {_EMIS_AFTER_SAMPLES}, {_STARTS_SQL}
""" + _series_sql("emis", "timestamp", schemas.EMISSION_METRICS, "run_start")),
    "host_metric_series": Query(host_metric_series, f"""
WITH {t.RUN_BINS_SQL} {_HOST_AFTER_SAMPLES}, {_STARTS_SQL}
""" + _series_sql("host", "datetime", schemas.HOST_METRICS, _SNAP)),
    "telemetry_summary": Query(telemetry_summary, f"""WITH {t.HOST_SQL}
SELECT min(datetime) AS first_time, max(datetime) AS last_time, count(*) AS points,
       min(cpu_cores_sum) AS cpu_cores_sum_min, max(cpu_cores_sum) AS cpu_cores_sum_max,
       min(memory_percent) AS memory_percent_min, max(memory_percent) AS memory_percent_max,
       min(gpu_0_util_percent) AS gpu_0_util_percent_min,
       max(gpu_0_util_percent) AS gpu_0_util_percent_max
FROM host"""),
    "sample_ticks": Query(sample_ticks, f"""WITH {t.HOST_SQL},
placed AS (
  SELECT ord, strftime(datetime, '%H:%M:%S') AS time_str,
         row_number() OVER (ORDER BY datetime, ord) - 1 AS position,
         count(*) OVER () AS n FROM host)
SELECT ord, time_str, position FROM placed
WHERE position IN (SELECT i * (n - 1) // greatest(least(8, n) - 1, 1)
                   FROM (SELECT max(n) AS n FROM placed), range(8) r(i))"""),
}
