import bisect
import csv
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.operators import capacity, report
from loadlens.sources.readers import read_load_samples, read_user_bins
from loadlens.sources.writers import write_user_bins

ROWS = [  # timeStamp, elapsed, label, success, allThreads, Latency
    ("0", "100", "HTTP Request", "true", "1", "100"),
    ("1000", "300", "HTTP Request", "false", "1", "300"),
    ("2000", "200", "HTTP Request", "true", "2", "200"),
    ("3000", "50", "Debug Sampler", "true", "2", "50"),
    ("4000", "abc", "HTTP Request", "true", "2", "10"),
    ("5000", "500", "HTTP Request", "FALSE", "11", "500"),
    ("6000", "700", "HTTP Request", "", "11", "700"),
    ("7000", "1", "HTTP Request", "true", "3", "1"),
    ("8000", "nan", "HTTP Request", "true", "3", "1"),
]


@pytest.fixture(scope="module")
def sample_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("jtl") / "results.jtl"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(schemas.SAMPLE_COLUMNS)
        for ts, elapsed, label, success, users, latency in ROWS:
            row = dict.fromkeys(schemas.SAMPLE_COLUMNS, "x") | {
                "timeStamp": ts, "elapsed": elapsed, "label": label, "success": success,
                "allThreads": users, "Latency": latency}
            line = [row[c] for c in schemas.SAMPLE_COLUMNS]
            out.writerow([*line, "surplus"] if ts == "7000" else line)
        out.writerow(["9000", "10", "HTTP Request"])  # short: no latency, dropped later
        out.writerow(["9500", "20", "Other", "a\nb, \"c\""] + [""] * 14)
    return str(path)


@pytest.fixture(scope="module")
def samples(spark, sample_file):
    return capacity.prepare_samples(read_load_samples(spark, sample_file)).cache()


def test_ragged_rows(spark, sample_file):
    raw = read_load_samples(spark, sample_file)
    assert raw.columns == schemas.SAMPLE_COLUMNS
    got = {r.timeStamp: r for r in raw.collect()}
    assert "7000" not in got and len(got) == len(ROWS) - 1 + 2
    assert got["9000"].label == "HTTP Request" and got["9000"].Latency is None
    assert got["9500"].responseCode == 'a\nb, "c"'
    assert raw.count() == len(got)
    assert raw.select("timeStamp").count() == len(got)


def test_thread_stats(samples):
    got = [tuple(r) for r in capacity.thread_stats(samples).drop("first_timestamp")
           .orderBy("allthreads").collect()]
    assert got == [(1, 2, 1, 50.0, 200.0), (2, 1, 0, 0.0, 200.0), (11, 2, 2, 100.0, 600.0)]


BINS = [(0, datetime(1970, 1, 1), 25.0, 200.0, 2), (10, datetime(1970, 1, 1, 0, 0, 5), 100.0, 600.0, 1)]


def test_user_bins_mean_of_means(samples):
    assert [tuple(r) for r in capacity.user_bins(samples).orderBy("user_bin").collect()] == BINS
    weighted = capacity.user_bins(samples, weighted=True).orderBy("user_bin").collect()
    assert weighted[0].avg_error_rate == pytest.approx(100 / 3)
    starts = capacity.bin_start_times(samples).orderBy("user_bin").collect()
    assert [tuple(r) for r in starts] == [b[:2] for b in BINS]


@pytest.mark.parametrize("threshold, expected", [(5.0, 0), (25.0, 10), (100.0, 10)])
def test_nmax(samples, threshold, expected):
    bins = capacity.user_bins(samples)
    assert capacity.nmax(bins, threshold).head().nmax == expected
    assert {r.nmax for r in capacity.error_rate_series(bins, threshold).collect()} == {expected}
    assert [r.y for r in capacity.elapsed_series(bins).orderBy("x").collect()] == [
        200 / 60000, 600 / 60000]


def test_nmax_empty(samples):
    assert capacity.nmax(capacity.user_bins(samples.limit(0))).head().nmax is None


def test_user_bin_floors(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (119,)], "x long")
    got = df.select(capacity.user_bin(F.col("x"), 10).alias("b")).collect()
    assert [r.b for r in got] == [-10, 0, 0, 10, 110]


def test_user_bins_round_trip(spark, samples, tmp_path):
    one = str(tmp_path / "run1")
    write_user_bins(capacity.user_bins(samples), one)
    back = read_user_bins(spark, [one, str(tmp_path / "none"), one])
    rows = back.orderBy("run_id", "ord").drop("ord").collect()
    assert [tuple(r) for r in rows] == [(*b, run) for run in (0, 2) for b in BINS]
    with pytest.raises(Exception):
        read_user_bins(spark, [str(tmp_path / "none")], strict=True)


def test_user_bins_written_elsewhere(spark, tmp_path):
    path = tmp_path / "run.csv"
    path.write_text("request_count,user_bin,bin_start_timestamp,avg_error_rate,avg_elapsed\n"
                    "3,0,2024-01-01 00:00:07.179000,1.5,20\n2,10,2024-01-01 00:01:00,,30.5\n")
    got = read_user_bins(spark, [str(path)]).orderBy("ord").collect()
    assert [(r.user_bin, r.bin_start_timestamp, r.avg_error_rate, r.request_count) for r in got] == [
        (0, datetime(2024, 1, 1, 0, 0, 7, 179000), 1.5, 3), (10, datetime(2024, 1, 1, 0, 1), None, 2)]


def test_written_bins_are_read_by_pandas(samples, tmp_path):
    write_user_bins(capacity.user_bins(samples), str(tmp_path / "bins"))
    parts = sorted((tmp_path / "bins").glob("part-*.csv"))
    frame = pd.concat([pd.read_csv(p, parse_dates=["bin_start_timestamp"]) for p in parts])
    assert [tuple(r) for r in frame.itertuples(index=False)] == BINS


def test_response_code(spark):
    df = spark.createDataFrame([("200",), ("1200x",), ("500",), (None,)], "responsecode string")
    assert [r.success for r in capacity.assert_response_code(df).collect()] == [
        True, True, False, False]


def test_report_total_and_percentiles(samples):
    df = samples.withColumns({"bytes": F.lit(1024), "sentbytes": F.lit(512)})
    got = {r.label: r for r in report.report_summary(df).collect()}
    total = got["Total"]
    assert got["HTTP Request"].samples == total.samples == 5 and total.failures == 3
    assert total.mean_elapsed == 360.0 and total.median == 300.0
    assert total.p90 == pytest.approx(620.0)
    assert total.throughput_per_sec == pytest.approx(5 / 6.7)


def test_sum_of_requests_is_sample_count(samples):
    total = capacity.thread_stats(samples).agg(F.sum("total_requests")).head()[0]
    assert total == samples.count()


def test_sketches_roll_up_within_the_rank_error(spark):
    """Slices of very different sizes, put together twice; one slice has most of the rows."""
    rows = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.when(
            F.col("id") % 3 == 0, F.lit(60)).otherwise(F.col("id") % 20_000)).alias("timestamp"),
        F.pow(F.rand(5) * 40, F.lit(2.5)).alias("elapsed"), (F.col("id") % 7 > 0).alias("success"))
    minutes = report.elapsed_sketches(rows)
    hours = report.roll_up(minutes, "1 hour")
    whole = report.roll_up(hours)
    assert minutes.count() > 300 and 5 <= hours.count() <= 7
    got = report.sketched_percentiles(whole, (0.01, 0.5, 0.9, 0.999)).head()
    assert (got.samples, got.failures) == (200_000, 200_000 - 171_428)
    exact = sorted(int(r.elapsed) for r in rows.select("elapsed").collect())
    for rank, value in ((0.01, got.p1), (0.5, got.p50), (0.9, got.p90), (0.999, got.p99_9)):
        low, high = (f(exact, value) / len(exact) for f in (bisect.bisect_left, bisect.bisect_right))
        assert low - 2 * report.rank_error() <= rank <= high + 2 * report.rank_error()
    assert max(len(r.elapsed_sketch) for r in whole.collect()) < 20_000
