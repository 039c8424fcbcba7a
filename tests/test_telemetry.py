from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens.functions.columns import require_columns
from loadlens.operators import telemetry
from loadlens.plans.position import with_position
from loadlens.sources.readers import read_emissions, read_host_metrics
from loadlens.sources.store import stored

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_moving_average_fixture(spark):
    values = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame(
        [(i, at(30 * i), v) for i, v in enumerate(values)], "ord int, ts timestamp, v double")
    got = telemetry.moving_average(df, ["v"], ["ts", "ord"]).orderBy("ord").collect()
    assert [r.v_ma for r in got] == pytest.approx([1.5, 7 / 3, 3.0, 4.25, 5.5, 5.5, 6.0])


@pytest.mark.parametrize("n, chunk", [(5, 4), (4, 3), (5, 1000), (1, 2)])
def test_moving_average_is_pandas_rolling(spark, n, chunk):
    rng = np.random.default_rng(n)
    frames = []
    for run in range(3):
        size = [97, 1, 30][run]
        gaps = np.sort(rng.integers(0, 4000, size))
        v = rng.normal(size=size)
        v[rng.random(size) < 0.2] = np.nan
        frames.append(pd.DataFrame({
            "run_id": run, "ord": np.arange(size), "sec": gaps, "v": v}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).withColumn(
        "ts", F.timestamp_seconds("sec"))
    got = telemetry.moving_average(
        df.repartition(5), ["v"], ["ts", "ord"], ["run_id"], n, chunk).orderBy("run_id", "ord").toPandas()
    want = pdf.groupby("run_id")["v"].transform(
        lambda s: s.rolling(n, center=True, min_periods=1).mean())
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["v_ma"].astype(float), want.to_numpy(), rtol=1e-12)


def test_rows_without_time_are_kept(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, at(0), 3.0)], "ord int, ts timestamp, v double")
    got = telemetry.moving_average(df, ["v"], ["ts", "ord"]).collect()
    assert sorted((r.ord, r.v_ma) for r in got) == [(0, 2.0), (1, 2.0)]


def test_positions_of_a_hot_timestamp_spread(spark, monkeypatch):
    rows = spark.range(20_000).select(
        F.col("id"), (F.col("id") % 2).alias("g"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("ts"))
    written = []

    def keep(df):
        written.append(stored(df))
        return written[-1]

    monkeypatch.setattr("loadlens.plans.position.stored", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_position(rows.repartition(6), ["ts", "id"], ["g"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000 / 4
    frame = got.toPandas().sort_values(["g", "ts", "id"])
    assert (frame["position"].to_numpy() == np.tile(np.arange(10_000), 2)).all()
    assert (frame["total"] == 10_000).all()


def test_core_sum_and_fallback(spark):
    df = spark.createDataFrame(
        [(10.0, None, 99.0)], "cpu_0_percent double, cpu_1_percent double, cpu_percent_total double")
    assert telemetry.cpu_cores_sum(df).head().cpu_cores_sum == 10.0
    assert telemetry.cpu_cores_sum(df.select("cpu_percent_total")).head().cpu_cores_sum == 99.0
    assert telemetry.cpu_cores_sum(spark.range(1)).head().cpu_cores_sum == 0.0
    caps = telemetry.with_capacity(df).head()
    assert (caps.cpu_cores_count, caps.cpu_max_possible) == (2, 200)
    alone = telemetry.with_capacity(df.select("cpu_percent_total")).head()
    assert (alone.cpu_cores_count, alone.cpu_max_possible) == (1, 100)
    none = telemetry.with_capacity(spark.range(1)).head()
    assert (none.cpu_cores_count, none.cpu_max_possible) == (0, 100)


def test_run_starts(spark):
    bins = spark.createDataFrame(
        [(0, 0, 10, at(120)), (0, 1, 0, at(60)), (1, 0, 20, at(540)), (1, 1, 10, at(180))],
        "run_id int, ord int, user_bin long, bin_start_timestamp timestamp")
    got = telemetry.run_starts(bins, "ord").orderBy("run_id").collect()
    assert [r.run_start for r in got] == [at(60), at(540)]
    first = telemetry.run_starts(bins.drop("user_bin"), "ord").orderBy("run_id").collect()
    assert [r.run_start for r in first] == [at(120), at(540)]


def test_snap(spark):
    metrics = spark.createDataFrame([(at(30),), (at(60),), (at(9000),)], "datetime timestamp")
    starts = spark.createDataFrame(
        [(0, at(31)), (1, at(60)), (2, at(120)), (3, at(9001)), (4, at(60)), (5, at(-90000))],
        "run_id int, run_start timestamp")
    got = telemetry.snap_run_starts(starts, metrics).orderBy("run_id").collect()
    assert [r.marker for r in got] == [at(60), at(60), at(9000), at(9001), at(60), at(30)]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9, 100])
def test_ticks_are_linspace(spark, n):
    df = spark.range(n).withColumn("ts", F.timestamp_seconds(F.col("id") * 700))
    got = telemetry.sample_ticks(df, ["ts"])
    want = np.linspace(0, n - 1, min(8, n), dtype=int).tolist()
    assert sorted(r.position for r in got.collect()) == want
    assert sorted(r.id for r in got.collect()) == want


def test_metric_series_skips_absent(spark):
    df = spark.createDataFrame([(at(0), 1.0, 2.0)], "timestamp timestamp, cpu_power double, x double")
    starts = spark.createDataFrame([(0, at(5))], "run_id int, run_start timestamp")
    got = telemetry.metric_series(df, starts, "timestamp").orderBy("kind").collect()
    assert [(r.kind, r.metric, r.unit, r.value, r.run_id) for r in got] == [
        ("run_start", None, None, None, 0), ("series", "cpu_power", "W", 1.0, None)]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["id", "b"])
    assert require_columns(spark.range(1), ["id", "b"], strict=False) == ["b"]


def test_readers(spark, tmp_path):
    host = tmp_path / "system_metrics.csv"
    host.write_text("timestamp,cpu_percent_total,cpu_0_percent,country,cpu_1_percent,memory_percent\n"
                    "1704067200000,5,1.5,X,2,40\n1704067230000,6,,X,4,41\n")
    df = telemetry.cpu_cores_sum(telemetry.with_time(read_host_metrics(spark, str(host))))
    got = df.orderBy("ord").collect()
    assert [(r.datetime, r.time_str, r.cpu_cores_sum) for r in got] == [
        (T0, "00:00:00", 3.5), (at(30), "00:00:30", 4.0)]
    bare = tmp_path / "bare.csv"
    bare.write_text("cpu_percent_total,gpu_model\n5,A\n6,B\n")
    with pytest.raises(ValueError):
        read_host_metrics(spark, str(bare))
    points = telemetry.with_time(read_host_metrics(spark, str(bare), strict=False))
    assert [(r.time_str, r.gpu_model) for r in points.orderBy("ord").collect()] == [
        ("Point 0", "A"), ("Point 1", "B")]
    emis = tmp_path / "emissions.csv"
    emis.write_text("timestamp,project_name,emissions,cpu_power\n2024-01-01T00:00:05,p,0.5,3\n")
    row = read_emissions(spark, str(emis)).head()
    assert (row.timestamp, row.emissions, row.cpu_power, row.project_name) == (at(5), 0.5, 3.0, "p")
    assert read_emissions(spark, str(emis), "+02:00").head().timestamp == at(5 - 7200)
    (tmp_path / "bad.csv").write_text("time,emissions\n1,2\n")
    with pytest.raises(ValueError):
        read_emissions(spark, str(tmp_path / "bad.csv"))


def ticks_of(frame, order_by, k):
    """Positions and row numbers of evenly spaced rows; ties in all of ``order_by`` may swap."""
    ranked = frame.sort_values(order_by, na_position="first", kind="stable").reset_index(drop=True)
    steps = min(k, len(ranked)) - 1
    places = sorted({i * (len(ranked) - 1) // max(steps, 1) for i in range(steps + 1)})
    return [(p, *ranked.loc[p, order_by]) for p in places]


@pytest.mark.parametrize("order_by", [["ts", "ord"], ["name", "ord"], ["ts"], ["name", "v", "ord"]])
def test_ticks_with_a_hot_value(spark, order_by):
    """A third of the rows share one timestamp and one name; some have none."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        sec = 500 if hot else int(rng.integers(0, 1000))
        rows.append((i, None if i % 50 == 1 else at(sec), "hot" if hot else f"n{i % 37:02}",
                     float(i % 5)))
    df = spark.createDataFrame(rows, "ord int, ts timestamp, name string, v double").repartition(6)
    frame = pd.DataFrame(rows, columns=["ord", "ts", "name", "v"])
    got = telemetry.sample_ticks(df, order_by, 11)
    assert got.columns == ["ord", "ts", "name", "v", "position"]
    found = sorted((r["position"], *[r[c] for c in order_by]) for r in got.collect())
    want = ticks_of(frame, order_by, 11)
    assert found == [tuple(None if v is pd.NaT else v for v in x) for x in want]


def test_ticks_of_equal_rows(spark):
    df = spark.range(100).select(F.lit(1).alias("x"))
    got = telemetry.sample_ticks(df, ["x"], 4).orderBy("position").collect()
    assert [(r.x, r.position) for r in got] == [(1, 0), (1, 33), (1, 66), (1, 99)]


def test_snap_over_ranges(spark):
    """Starts before, between, on and after ticks; empty ranges; many starts and one hot tick."""
    rng = np.random.default_rng(8)
    seconds = [int(s) for s in rng.integers(0, 100_000, 400)] + [50_000] * 300
    starts = [(i, at(int(s))) for i, s in enumerate(rng.integers(-500, 101_000, 700))]
    starts += [(1000, at(50_000)), (1001, None), (1002, at(min(seconds))), (1003, at(-9_999))]
    metrics = spark.createDataFrame([(at(s),) for s in seconds] + [(None,)], "datetime timestamp")
    df = spark.createDataFrame(starts, "run_id int, run_start timestamp")
    got = {r.run_id: r.marker for r in telemetry.snap_run_starts(df, metrics.repartition(5)).collect()}
    ordered = sorted(set(seconds))

    def marker(start):
        later = [at(s) for s in ordered if start is not None and at(s) >= start]
        return later[0] if later else start
    assert got == {i: marker(s) for i, s in starts}


def test_snap_without_ticks(spark):
    df = spark.createDataFrame([(1, at(5))], "run_id int, run_start timestamp")
    none = spark.createDataFrame([], "datetime timestamp")
    assert telemetry.snap_run_starts(df, none).collect() == [(1, at(5), at(5))]
