"""Streaming queries, run over the whole table to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.sources.store import new_folder
from loadlens.streaming import live


def stream_host_metrics(spark, sf):
    metrics = t.host_metrics(live.streaming_session(spark), sf, stream=True)
    folder = new_folder(spark)
    windows = live.live_host_metrics(metrics, ["cpu_cores_sum", "memory_percent"], every="1 hour")
    live.run_append(windows, folder).awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{folder}/rows").withColumns({
        c: F.round(c, 6) for c in ("cpu_cores_sum_avg", "memory_percent_avg")})


# Files a run of events is written as; so many make a batch.
_FILES = 4
# Partitions of the state; there are a few dozen bins.
_STATE = 4


def _by_run(spark, sf, start):
    """Events arrive run by run, each run a batch of one query."""
    source, folder = new_folder(spark), new_folder(spark)
    events = t.table(spark, sf, "events")
    for run in range(3):
        events.filter(t.run_of(F.col("ts").cast("timestamp")) == run).repartition(
            _FILES).write.mode("append").parquet(f"{source}/events.parquet")
    child = live.streaming_session(spark, _STATE)
    query = start(t.clean_samples(child, source, stream=True, per_batch=_FILES), folder)
    query.awaitTermination()
    return folder


def stream_user_bins(spark, sf):
    folder = _by_run(spark, sf, live.run_user_bins)
    return live.latest_batch(spark, f"{folder}/bins").withColumns({
        c: F.round(c, 6) for c in ("avg_error_rate", "avg_elapsed")})


def stream_saturation(spark, sf):
    folder = _by_run(spark, sf, lambda samples, out: live.run_saturation_alerts(
        samples, out, threshold=25.0))
    return live.raised_alerts(spark, folder).withColumn("error_rate", F.round("error_rate", 6))


def stream_dedup(spark, sf):
    folder = new_folder(spark)
    firsts = live.live_dedup(
        t.spans(live.streaming_session(spark), sf, stream=True), late="4000 days").select("question")
    live.run_append(firsts, folder).awaitTermination()
    return spark.read.schema(firsts.schema).parquet(f"{folder}/rows")


QUERIES = {
    "stream_host_metrics": Query(stream_host_metrics, f"""WITH {t.HOST_SQL},
hours AS (SELECT *, date_trunc('hour', datetime)::TIMESTAMP AS window_start FROM host)
SELECT window_start, count(*) AS points,
       round(avg(cpu_cores_sum), 6) AS cpu_cores_sum_avg, max(cpu_cores_sum) AS cpu_cores_sum_max,
       round(avg(memory_percent), 6) AS memory_percent_avg, max(memory_percent) AS memory_percent_max
FROM hours
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(datetime) - INTERVAL 2 MINUTE FROM host)
GROUP BY window_start"""),
    "stream_user_bins": Query(stream_user_bins, f"""WITH {t.STATS_SQL}
SELECT user_bin, bin_start_timestamp, round(avg_error_rate, 6) AS avg_error_rate,
       round(avg_elapsed, 6) AS avg_elapsed, request_count FROM bins"""),
    "stream_saturation": Query(stream_saturation, f"""WITH {t.SAMPLES_SQL},
arrived AS (
  SELECT (allthreads // 10) * 10 AS user_bin, run_id, count(*) AS n,
         count(*) FILTER (WHERE NOT success) AS failed
  FROM clean GROUP BY ALL),
running AS (
  SELECT user_bin, run_id, sum(n) OVER w AS total_requests, sum(failed) OVER w AS failed_requests
  FROM arrived WINDOW w AS (PARTITION BY user_bin ORDER BY run_id)),
raised AS (
  SELECT *, row_number() OVER (PARTITION BY user_bin ORDER BY run_id) AS place
  FROM running WHERE 100.0 * failed_requests / total_requests > 25)
SELECT user_bin, CAST(total_requests AS BIGINT) AS total_requests,
       CAST(failed_requests AS BIGINT) AS failed_requests,
       round(100.0 * failed_requests / total_requests, 6) AS error_rate
FROM raised WHERE place = 1"""),
    "stream_dedup": Query(stream_dedup, f"WITH {t.SPANS_SQL} SELECT DISTINCT question FROM spans"),
}
