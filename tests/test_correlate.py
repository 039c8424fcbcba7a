from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadlens.operators import correlate, telemetry
from loadlens.sources.writers import write_correlated, write_traces

T0 = datetime(2024, 1, 1)


def at(clock):
    h, m, s = (int(x) for x in clock.split(":"))
    return T0 + timedelta(hours=h, minutes=m, seconds=s)


BINS = [
    (0, 0, "00:00:00"), (0, 50, "00:05:00"), (0, 100, "00:10:00"), (0, 200, "00:20:00"),
    (1, 0, "01:00:00"), (1, 100, "01:10:00"),
]
HOST = ["00:00:30", "00:09:50", "00:10:10", "00:20:31", "00:59:50", "01:00:20", "01:10:00"]


def make_bins(spark, rows=BINS):
    return spark.createDataFrame(
        [(r, b, at(t), 1.0, 2.0) for r, b, t in rows],
        "run_id int, user_bin long, bin_start_timestamp timestamp, avg_error_rate double, "
        "avg_elapsed double")


def make_host(spark, clocks=HOST):
    return spark.createDataFrame(
        [(i, at(t), float(i)) for i, t in enumerate(clocks)],
        "ord int, datetime timestamp, memory_percent double")


def test_windows(spark):
    got = correlate.run_windows(make_bins(spark)).orderBy("run_id").collect()
    assert [(r.run_start, r.run_end) for r in got] == [
        (at("00:00:00"), at("00:55:00")), (at("01:00:00"), None)]


def test_fixture(spark):
    found = correlate.concat_runs(correlate.correlate_host(
        make_bins(spark), make_host(spark), ["ord"]))
    got = found.orderBy("run_id", "user_bin").collect()
    assert [(r.run_id, r.user_bin, r.memory_percent, r.run_offset, r.global_users) for r in got] == [
        (0, 0, 0.0, 0, 0), (0, 100, 1.0, 0, 100), (1, 0, 5.0, 100, 100), (1, 100, 6.0, 100, 200)]
    assert got[0].cpu_usage is None and got[0].gpu_util is None
    separators = correlate.run_separators(found).orderBy("label").collect()
    assert [(r.run_id, r.run_offset, r.label) for r in separators] == [(0, 0, 0), (1, 100, 1)]


def test_run_without_metrics_has_no_offset(spark):
    rows = [*BINS[:4], (1, 0, "05:00:00"), (1, 900, "05:10:00"), (2, 0, "06:00:00")]
    host = make_host(spark, [*HOST[:4], "06:00:01"])
    found = correlate.concat_runs(correlate.correlate_host(make_bins(spark, rows), host, ["ord"]))
    separators = correlate.run_separators(found).orderBy("label").collect()
    assert [(r.run_id, r.run_offset, r.label) for r in separators] == [(0, 0, 0), (2, 100, 1)]


def test_phase2_has_no_window(spark):
    bins = make_bins(spark).filter("run_id = 1")
    got = correlate.correlate_phase2(bins, make_host(spark), ["ord"]).orderBy("user_bin").collect()
    assert [(r.user_bin, r.memory_percent, r.time_diff_seconds) for r in got] == [
        (0, 4.0, 10.0), (100, 6.0, 0.0)]
    assert got[0].system_timestamp == at("00:59:50") and got[0].cpu_cores_count == 1
    every = correlate.correlate_phase2(make_bins(spark), make_host(spark), ["ord"], 29)
    missing = correlate.unmatched_bins(make_bins(spark).filter("run_id = 0"), every)
    assert [r.user_bin for r in missing.collect()] == [200]


def brute(bins, ticks, tol, windows):
    out = {}
    for key, (run, t) in enumerate(bins):
        lo, hi = windows[run]
        best = min(
            ((abs(m - t), i) for i, m in enumerate(ticks) if lo <= m and (hi is None or m <= hi)),
            default=None)
        if best and best[0] <= tol:
            out[key] = best[1]
    return out


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 300)), min_size=1, max_size=25),
    st.lists(st.integers(-60, 320), min_size=1, max_size=40),
    st.sampled_from([0, 1, 3, 30]),
    st.integers(0, 100),
)
def test_nearest_is_brute_force(spark, bins, ticks, tol, start):
    windows = {0: (start, start + 80), 1: (start + 50, start + 200), 2: (start + 100, None)}
    def ts(s):
        return T0 + timedelta(seconds=s)

    left = spark.createDataFrame(
        [(i, r, ts(t)) for i, (r, t) in enumerate(bins)],
        "key int, run_id int, bin_start_timestamp timestamp")
    right = spark.createDataFrame(
        [(i, ts(m)) for i, m in enumerate(ticks)], "ord int, datetime timestamp")
    periods = spark.createDataFrame(
        [(r, ts(a), None if b is None else ts(b)) for r, (a, b) in windows.items()],
        "run_id int, run_start timestamp, run_end timestamp")
    inside = [(r, t) for r, t in bins]
    want = brute(inside, ticks, tol, windows)
    want = {k: v for k, v in want.items()
            if windows[bins[k][0]][0] <= bins[k][1]
            and (windows[bins[k][0]][1] is None or bins[k][1] <= windows[bins[k][0]][1])}
    found = correlate.nearest_join(left, right, [F.col("ord").alias("o")], "datetime", ["ord"],
                                   tol, periods)
    assert {r.key: r.match.payload.o for r in found.collect()} == want
    free = correlate.nearest_join(left, right, [F.col("ord").alias("o")], "datetime", ["ord"], tol)
    everywhere = {r: (-10**9, None) for r in range(3)}
    assert {r.key: r.match.payload.o for r in free.collect()} == brute(inside, ticks, tol, everywhere)


def test_assign_runs(spark):
    host = make_host(spark, [*HOST, "40:00:00"])
    windows = correlate.run_windows(make_bins(spark))
    got = correlate.assign_runs(host, windows, "datetime").collect()
    assert sorted((r.ord, r.run_id) for r in got) == [
        (0, 0), (1, 0), (2, 0), (3, 0), (5, 1), (6, 1), (7, 1)]


def test_annotation_and_null_metrics(spark):
    df = spark.range(0, 2300, 100).select(F.col("id").alias("user_bin"))
    got = correlate.annotate_points(df).orderBy("position").collect()
    assert [r.position for r in got] == list(range(0, 23, 4))
    few = correlate.annotate_points(df.limit(3)).collect()
    assert len(few) == 3
    long = spark.createDataFrame(
        [("a", None), ("a", 1.0), ("b", None)], "metric string, value double")
    assert {r.metric for r in correlate.drop_all_null_metrics(long).collect()} == {"a"}


@pytest.fixture(scope="module")
def host_plan(spark):
    found = correlate.concat_runs(correlate.correlate_host(
        make_bins(spark), make_host(spark), ["ord"]))
    return found._jdf.queryExecution().toString()


@pytest.mark.parametrize("word", ["CartesianProduct", "BroadcastNestedLoopJoin", "Python"])
def test_plan_has_no_cross_join_or_python(host_plan, word):
    assert word not in host_plan


def test_snap_plan_has_no_cross_join(spark):
    starts = telemetry.run_starts(make_bins(spark))
    plan = telemetry.snap_run_starts(starts, make_host(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_written_tables(spark, tmp_path):
    found = correlate.correlate_phase2(
        make_bins(spark).filter("run_id = 1"), make_host(spark), ["ord"])
    write_correlated(found, str(tmp_path / "correlated"))
    back = spark.read.csv(str(tmp_path / "correlated"), header=True, inferSchema=True)
    assert back.columns == found.columns
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in found.collect())
    write_traces(found, str(tmp_path / "traces"))
    assert spark.read.parquet(str(tmp_path / "traces")).exceptAll(found).count() == 0


def test_optional_metrics_and_total_cpu(spark):
    host = make_host(spark).withColumns({
        "cpu_percent_total": F.col("ord") * 2.0, "gpu_0_util_percent": F.lit(7)})
    bins = make_bins(spark)
    got = correlate.correlate_host(bins, host, ["ord"]).orderBy("run_id", "user_bin").collect()
    assert [(r.cpu_usage, r.gpu_util, r.gpu_mem) for r in got][1] == (2.0, 7.0, None)
    cores = host.withColumns({"cpu_0_percent": F.lit(1.5), "cpu_1_percent": F.lit(None).cast("double")})
    phase2 = correlate.correlate_phase2(bins.filter("run_id = 1"), cores, ["ord"]).collect()
    assert {(r.cpu_usage, r.cpu_cores_count) for r in phase2} == {(1.5, 2)}
    emissions = make_host(spark).select(
        "ord", F.col("datetime").alias("timestamp"), F.lit(3.0).alias("cpu_power"))
    row = correlate.correlate_emissions(bins, emissions, ["ord"]).head()
    assert row.cpu_power == 3.0 and row.energy_consumed is None
    summary = correlate.correlation_summary(correlate.correlate_phase2(
        bins.filter("run_id = 1"), cores, ["ord"])).head()
    assert (summary.points, summary.user_bin_min, summary.user_bin_max) == (2, 0, 100)


def test_times_without_zone(spark):
    bins = make_bins(spark).withColumn(
        "bin_start_timestamp", F.col("bin_start_timestamp").cast("timestamp_ntz"))
    host = make_host(spark).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    assert correlate.correlate_host(bins, host, ["ord"]).count() == 4
