"""Queries of load-test capacity and of the run report."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.functions.text import extract_json
from loadlens.operators import capacity, report

_SAMPLE_COLS = "ord, run_id, timestamp, elapsed, label, responsecode, success, allthreads"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def normalise_columns(spark, sf):
    return capacity.normalise_columns(t.load_samples(spark, sf))


def filter_label(spark, sf):
    return capacity.filter_label(t.load_samples(spark, sf)).select("ord", "label", "elapsed")


def clean_numeric(spark, sf):
    k = F.col("bytes") % 10
    text = (
        F.when(k == 0, "nan").when(k == 1, "abc").when(k == 2, "12d").when(k == 3, " 77 ")
        .when(k == 4, "1e3").when(k == 5, "").when(k == 6, "-.5")
        .otherwise(F.col("elapsed").cast("string")))
    dirty = capacity.normalise_columns(t.load_samples(spark, sf)).withColumn("elapsed", text)
    return capacity.clean_numeric(dirty).select("ord", "timestamp", "elapsed", "allthreads")


CLEAN_SQL = f"""WITH {t.SAMPLES_SQL}
SELECT ord, timestamp, allthreads,
       CASE bytes % 10 WHEN 3 THEN 77.0::DOUBLE WHEN 4 THEN 1000.0::DOUBLE
            WHEN 6 THEN -0.5::DOUBLE ELSE CAST(elapsed AS DOUBLE) END AS elapsed
FROM raw WHERE bytes % 10 NOT IN (0, 1, 2, 5)"""


def derive_sample_fields(spark, sf):
    raw = capacity.normalise_columns(t.load_samples(spark, sf))
    return capacity.derive_sample_fields(raw).select("ord", "timestamp", "success")


def thread_stats(spark, sf):
    return _rounded(capacity.thread_stats(t.clean_samples(spark, sf)), "error_rate", "avg_elapsed")


def user_bin(spark, sf):
    df = t.clean_samples(spark, sf)
    shifted = F.col("allthreads") - 25
    return df.select(
        "ord", capacity.user_bin(F.col("allthreads"), 100).alias("search_bin"),
        capacity.user_bin(shifted, 10).alias("shifted_bin"))


def bin_start_times(spark, sf):
    return capacity.bin_start_times(t.clean_samples(spark, sf))


def bin_stats(spark, sf):
    stats = capacity.thread_stats(t.clean_samples(spark, sf))
    return _rounded(capacity.bin_stats(stats), "avg_error_rate", "avg_elapsed")


def bin_stats_weighted(spark, sf):
    stats = capacity.thread_stats(t.clean_samples(spark, sf))
    return _rounded(capacity.bin_stats(stats, weighted=True), "avg_error_rate", "avg_elapsed")


def user_bins(spark, sf):
    return _rounded(t.bins(spark, sf), "avg_error_rate", "avg_elapsed")


def user_bins_by_run(spark, sf):
    return _rounded(t.run_bins(spark, sf), "avg_error_rate", "avg_elapsed")


def nmax(spark, sf):
    bins = t.saved_bins(spark, sf)
    found = [
        capacity.nmax(bins, x).select(F.lit(x).alias("threshold"), "nmax")
        for x in (5.0, 25.0, 28.0, 30.0)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


NMAX_SQL = f"""WITH {t.STATS_SQL}
SELECT threshold, coalesce(min(user_bin) FILTER (WHERE avg_error_rate > threshold),
                           max(user_bin)) AS nmax
FROM bins, (SELECT unnest([5.0, 25.0, 28.0, 30.0])::DOUBLE AS threshold) GROUP BY threshold"""


def nmax_by_run(spark, sf):
    return capacity.nmax(t.run_bins(spark, sf), 25.0, by=["run_id"])


def error_rate_series(spark, sf):
    return _rounded(capacity.error_rate_series(t.saved_bins(spark, sf), 25.0), "y")


def elapsed_series(spark, sf):
    return _rounded(capacity.elapsed_series(t.saved_bins(spark, sf), 25.0), "y")


def _series_sql(y: str) -> str:
    return f"""WITH {t.STATS_SQL}
SELECT user_bin AS x, round({y}, 6) AS y,
       (SELECT coalesce(min(user_bin) FILTER (WHERE avg_error_rate > 25), max(user_bin))
        FROM bins) AS nmax
FROM bins"""


def assert_response_code(spark, sf):
    raw = capacity.normalise_columns(t.load_samples(spark, sf)).drop("success")
    return capacity.assert_response_code(raw).select("ord", "success", "failuremessage")


def extract_json_answer(spark, sf):
    turn = F.col("turn")
    reply = (
        F.when(turn % 3 == 0, F.to_json(F.struct(F.col("text").alias("response"))))
        .when(turn % 3 == 1, F.to_json(F.struct(F.array(F.struct("text")).alias("choices"))))
        .otherwise(F.to_json(F.struct(F.col("role").alias("error")))))
    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        extract_json(reply, ("$.response", "$.choices[0].text")).alias("generated_answer"))


_STAT_COLS = (
    "mean_elapsed", "median", "p90", "p95", "p99", "throughput_per_sec", "error_pct",
    "received_kb_per_sec", "sent_kb_per_sec")


def report_summary(spark, sf):
    raw = capacity.derive_sample_fields(capacity.normalise_columns(t.load_samples(spark, sf)))
    return _rounded(report.report_summary(raw), *_STAT_COLS)


_ELAPSED_SQL = """round(avg(elapsed), 6) AS mean_elapsed, min(elapsed) AS min_elapsed,
       max(elapsed) AS max_elapsed, round(quantile_cont(elapsed, 0.5), 6) AS median,
       round(quantile_cont(elapsed, 0.9), 6) AS p90,
       round(quantile_cont(elapsed, 0.95), 6) AS p95,
       round(quantile_cont(elapsed, 0.99), 6) AS p99"""

REPORT_SQL = f"""WITH {t.SAMPLES_SQL},
span AS (
  SELECT label, grouping(label) AS g, count(*) AS n, sum(bytes) AS b, sum(sentbytes) AS s,
         count(*) FILTER (WHERE success = 'false') AS failures,
         (max(timestamp + elapsed) - min(timestamp)) / 1000.0::DOUBLE AS seconds, {_ELAPSED_SQL}
  FROM raw GROUP BY ROLLUP (label))
SELECT CASE WHEN g = 1 THEN 'Total' ELSE label END AS label, n AS samples, failures,
       round(100.0 * failures / n, 6) AS error_pct, mean_elapsed, min_elapsed, max_elapsed,
       median, p90, p95, p99, round(n / seconds, 6) AS throughput_per_sec,
       round(b / 1024.0::DOUBLE / seconds, 6) AS received_kb_per_sec,
       round(s / 1024.0::DOUBLE / seconds, 6) AS sent_kb_per_sec
FROM span"""


def report_errors(spark, sf):
    return _rounded(
        report.report_errors(t.clean_samples(spark, sf)), "pct_of_errors", "pct_of_samples")


def report_top_errors(spark, sf):
    detail = F.concat("responsemessage", F.lit(" "), F.col("allthreads") % 9)
    df = t.clean_samples(spark, sf).withColumn("responsemessage", detail)
    return report.report_top_errors(df).withColumn("rank", F.col("rank").cast("long"))


def report_over_time(spark, sf):
    df = report.report_over_time(t.clean_samples(spark, sf), "1 hour")
    return _rounded(df, "mean_elapsed", "median", "p90", "p95", "p99", "throughput_per_sec")


_RANKS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _ranks_hold(rolled, samples, keys):
    """Whether the exact rank of each sketched percentile is within twice the stated error."""
    found = report.sketched_percentiles(rolled, [*_RANKS.values()])
    counted = samples.groupBy(*keys, F.col("elapsed").cast("long").alias("ms")).agg(
        F.count(F.lit(1)).alias("n"))
    error = 2 * report.rank_error()
    checks = []
    for name, rank in _RANKS.items():
        below = F.sum(F.when(F.col("ms") < F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        up_to = F.sum(F.when(F.col("ms") <= F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        checks.append(((below <= rank + error) & (up_to >= rank - error)).alias(f"{name}_holds"))
    return counted.join(found, keys).groupBy(*keys, "samples", "failures").agg(*checks)


def report_rolled_up(spark, sf):
    """Minute sketches rolled up to hours, and the hours to runs."""
    samples = t.clean_samples(spark, sf)
    minutes = report.elapsed_sketches(samples, by=["run_id"])
    hours = report.roll_up(minutes, "1 hour", ["run_id"])
    runs = report.roll_up(hours, by=["run_id"])
    by_hour = _ranks_hold(hours, samples.withColumn(
        "window_start", F.date_trunc("hour", "timestamp")), ["run_id", "window_start"])
    by_run = _ranks_hold(runs, samples, ["run_id"]).withColumn(
        "window_start", F.lit(None).cast("timestamp"))
    return by_hour.unionByName(by_run)


def codes_over_time(spark, sf):
    return _rounded(report.codes_over_time(t.clean_samples(spark, sf)), "per_sec")


def run_summary(spark, sf):
    return report.run_summary(t.load_samples(spark, sf))


def run_file_summary(spark, sf):
    files = report.run_file_summary(t.table(spark, sf, "events"))
    return files.select(F.element_at(F.split("file", "/"), -1).alias("file"), "lines")


QUERIES = {
    "normalise_columns": Query(normalise_columns, f"WITH {t.SAMPLES_SQL} SELECT * FROM raw"),
    "filter_label": Query(filter_label, f"""WITH {t.SAMPLES_SQL}
SELECT ord, label, elapsed FROM raw WHERE label = 'HTTP Request'"""),
    "clean_numeric": Query(clean_numeric, CLEAN_SQL),
    "derive_sample_fields": Query(derive_sample_fields, f"""WITH {t.SAMPLES_SQL}
SELECT ord, make_timestamp(timestamp * 1000) AS timestamp, success = 'true' AS success FROM raw"""),
    "thread_stats": Query(thread_stats, f"""WITH {t.STATS_SQL}
SELECT * REPLACE (round(error_rate, 6) AS error_rate, round(avg_elapsed, 6) AS avg_elapsed)
FROM stats"""),
    "user_bin": Query(user_bin, f"""WITH {t.SAMPLES_SQL}
SELECT ord, CAST(floor(allthreads / 100.0) * 100 AS BIGINT) AS search_bin,
       CAST(floor((allthreads - 25) / 10.0) * 10 AS BIGINT) AS shifted_bin FROM clean"""),
    "bin_start_times": Query(bin_start_times, f"""WITH {t.SAMPLES_SQL}
SELECT (allthreads // 10) * 10 AS user_bin, min(timestamp) AS bin_start_timestamp
FROM clean GROUP BY ALL"""),
    "bin_stats": Query(bin_stats, f"""WITH {t.STATS_SQL}
SELECT user_bin, bin_start_timestamp, round(avg_error_rate, 6) AS avg_error_rate,
       round(avg_elapsed, 6) AS avg_elapsed, request_count FROM bins"""),
    "bin_stats_weighted": Query(bin_stats_weighted, f"""WITH {t.STATS_SQL}
SELECT (allthreads // 10) * 10 AS user_bin, min(timestamp) AS bin_start_timestamp,
       round(100.0 * count(*) FILTER (WHERE NOT success) / count(*), 6) AS avg_error_rate,
       round(avg(elapsed), 6) AS avg_elapsed, count(DISTINCT allthreads) AS request_count
FROM clean GROUP BY ALL"""),
    "user_bins": Query(user_bins, f"""WITH {t.STATS_SQL}
SELECT user_bin, bin_start_timestamp, round(avg_error_rate, 6) AS avg_error_rate,
       round(avg_elapsed, 6) AS avg_elapsed, request_count FROM bins"""),
    "user_bins_by_run": Query(user_bins_by_run, f"""WITH {t.RUN_BINS_SQL}
SELECT run_id, user_bin, bin_start_timestamp, round(avg_error_rate, 6) AS avg_error_rate,
       round(avg_elapsed, 6) AS avg_elapsed, request_count FROM bins"""),
    "nmax": Query(nmax, NMAX_SQL),
    "nmax_by_run": Query(nmax_by_run, f"""WITH {t.RUN_BINS_SQL}
SELECT run_id, coalesce(min(user_bin) FILTER (WHERE avg_error_rate > 25), max(user_bin)) AS nmax
FROM bins GROUP BY run_id"""),
    "error_rate_series": Query(error_rate_series, _series_sql("avg_error_rate")),
    "elapsed_series": Query(elapsed_series, _series_sql("avg_elapsed / 60000")),
    "assert_response_code": Query(assert_response_code, f"""WITH {t.SAMPLES_SQL}
SELECT ord, responsecode LIKE '%200%' AS success,
       CASE WHEN responsecode LIKE '%200%' THEN ''
            ELSE 'Test failed: code expected to contain /200/' END AS failuremessage FROM raw"""),
    "extract_json_answer": Query(extract_json_answer, """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'NO_ANSWER_FOUND' ELSE text END
       AS generated_answer FROM conversations"""),
    "report_summary": Query(report_summary, REPORT_SQL),
    "report_errors": Query(report_errors, f"""WITH {t.SAMPLES_SQL}
SELECT responsecode, responsemessage, count(*) AS errors,
       round(100.0 * count(*) / (SELECT count(*) FROM clean WHERE NOT success), 6)
         AS pct_of_errors,
       round(100.0 * count(*) / (SELECT count(*) FROM clean), 6) AS pct_of_samples
FROM clean WHERE NOT success GROUP BY ALL"""),
    "report_top_errors": Query(report_top_errors, f"""WITH {t.SAMPLES_SQL},
counted AS (
  SELECT label, responsecode, responsemessage || ' ' || (allthreads % 9) AS responsemessage,
         count(*) AS errors FROM clean WHERE NOT success GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY label
       ORDER BY errors DESC, responsecode, responsemessage) AS rank
FROM counted QUALIFY rank <= 5"""),
    "report_over_time": Query(report_over_time, f"""WITH {t.SAMPLES_SQL}
SELECT date_trunc('hour', timestamp)::TIMESTAMP AS window_start, count(*) AS samples,
       count(*) FILTER (WHERE NOT success) AS failures, max(allthreads) AS active_users,
       round(count(*) / 3600.0::DOUBLE, 6) AS throughput_per_sec, {_ELAPSED_SQL}
FROM clean GROUP BY ALL"""),
    "report_rolled_up": Query(report_rolled_up, f"""WITH {t.SAMPLES_SQL}
SELECT run_id, date_trunc('hour', timestamp)::TIMESTAMP AS window_start, count(*) AS samples,
       count(*) FILTER (WHERE NOT success) AS failures,
       true AS p50_holds, true AS p90_holds, true AS p99_holds
FROM clean GROUP BY ALL
UNION ALL
SELECT run_id, NULL, count(*), count(*) FILTER (WHERE NOT success), true, true, true
FROM clean GROUP BY run_id"""),
    "codes_over_time": Query(codes_over_time, f"""WITH {t.SAMPLES_SQL}
SELECT date_trunc('minute', timestamp)::TIMESTAMP AS window_start, responsecode,
       count(*) AS responses, round(count(*) / 60.0::DOUBLE, 6) AS per_sec
FROM clean GROUP BY ALL"""),
    "run_summary": Query(run_summary, f"""WITH {t.SAMPLES_SQL}
SELECT run_id, count(*) AS lines FROM raw GROUP BY run_id"""),
    "run_file_summary": Query(run_file_summary, """
SELECT 'events.parquet' AS file, count(*) AS lines FROM events"""),
}
