import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadlens.operators import capacity
from loadlens.session import shared_dir
from loadlens.sources.readers import RAGGED, drop_surplus, ragged_layout, read_load_samples
from loadlens.sources.streams import stream_host_metrics, stream_load_samples
from loadlens.streaming import live

T0 = datetime(2024, 1, 1)
HEADER = "timeStamp,elapsed,label,success,allThreads,Latency"
NAMES = HEADER.split(",")


@pytest.fixture
def sample_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = 0
    for part in range(4):
        lines = [HEADER]
        for _ in range(50):
            ok = "false" if row % (3 + part) == 0 else "true"
            lines.append(f"{1_700_000_000_000 + row * 250},{row % 17 * 10},HTTP Request,{ok},{row % 37},1")
            row += 1
        lines.append(f"{1_700_000_000_000 + row},1,HTTP Request,false,3,1,surplus")
        lines.append(f"{1_700_000_000_000 + row},1,HTTP Request")
        (folder / f"{part}.csv").write_text("\n".join(lines) + "\n")
    return folder


def samples(spark, folder, stream):
    if stream:
        raw = stream_load_samples(spark, str(folder), NAMES)
    else:
        raw = read_load_samples(spark, str(folder))
    return capacity.prepare_samples(raw)


def one_file_per_batch(spark, folder, names):
    raw = spark.readStream.schema(ragged_layout(names)).option(
        "maxFilesPerTrigger", 1).csv(str(folder), **RAGGED)
    return capacity.prepare_samples(drop_surplus(raw))


def test_bins_over_batches_equal_batch_bins(spark, sample_folder, tmp_path):
    out = str(tmp_path / "out")
    query = live.run_user_bins(one_file_per_batch(spark, sample_folder, NAMES), out)
    query.awaitTermination()
    got = live.latest_batch(spark, f"{out}/bins").orderBy("user_bin").toPandas()
    want = capacity.bin_stats(capacity.thread_stats(samples(spark, sample_folder, False)))
    want = want.orderBy("user_bin").toPandas()[list(got.columns)]
    assert len(query.recentProgress) >= 4
    assert got.round(9).equals(want.round(9))


def arriving(folder):
    """Files arrive in the order of their names, a second apart."""
    for part in range(4):
        os.utime(folder / f"{part}.csv", (1_700_000_000 + part,) * 2)


def running(spark, folder):
    """(files so far, bin, requests, failures, rate) after each file."""
    frame = samples(spark, folder, False).withColumn(
        "part", ((F.unix_millis("timestamp") - 1_700_000_000_000) / 12_500).cast("int")).toPandas()
    for last in range(4):
        seen = frame[frame["part"] <= last]
        for user_bin, rows in seen.groupby(seen["allthreads"] // 10 * 10):
            bad = int((~rows["success"]).sum())
            yield last, user_bin, len(rows), bad, 100.0 * bad / len(rows)


def first_alerts(spark, folder, threshold):
    held = {}
    for _, user_bin, n, bad, rate in running(spark, folder):
        if rate > threshold and user_bin not in held:
            held[user_bin] = (n, bad, rate)
    return held


def alerts_in(spark, out):
    found = [(r.user_bin, (r.total_requests, r.failed_requests, r.error_rate))
             for r in live.raised_alerts(spark, out).collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_alerts_of_four_batches_in_one_query(spark, sample_folder, tmp_path):
    arriving(sample_folder)
    out = str(tmp_path / "out")
    query = live.run_saturation_alerts(
        one_file_per_batch(spark, sample_folder, NAMES), out, threshold=28.0)
    query.awaitTermination()
    assert [p.numInputRows > 0 for p in query.recentProgress].count(True) == 4
    want = first_alerts(spark, sample_folder, 28.0)
    assert alerts_in(spark, out) == want and any(n < 20 for n, _, _ in want.values())


@pytest.fixture
def small_arrow_batches(spark):
    """A task gets its rows in several Arrow batches, as it does beyond 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def test_alerts_when_a_task_has_several_arrow_batches(
        spark, sample_folder, tmp_path, small_arrow_batches):
    arriving(sample_folder)
    out = str(tmp_path / "out")
    live.run_saturation_alerts(
        one_file_per_batch(spark, sample_folder, NAMES), out, threshold=28.0).awaitTermination()
    assert alerts_in(spark, out) == first_alerts(spark, sample_folder, 28.0) != {}


def test_bins_when_a_task_has_several_arrow_batches(
        spark, sample_folder, tmp_path, small_arrow_batches):
    out = str(tmp_path / "out")
    live.run_user_bins(one_file_per_batch(spark, sample_folder, NAMES), out).awaitTermination()
    got = live.latest_batch(spark, f"{out}/bins").orderBy("user_bin").toPandas()
    want = capacity.bin_stats(capacity.thread_stats(samples(spark, sample_folder, False)))
    want = want.orderBy("user_bin").toPandas()[list(got.columns)]
    assert got.round(9).equals(want.round(9))


def test_alerts_after_a_restart_between_batches(spark, sample_folder, tmp_path):
    arriving(sample_folder)
    out, late = str(tmp_path / "out"), tmp_path / "late"
    late.mkdir()
    for part in (2, 3):
        (sample_folder / f"{part}.csv").rename(late / f"{part}.csv")

    def run():
        query = live.run_saturation_alerts(
            one_file_per_batch(spark, sample_folder, NAMES), out, threshold=28.0)
        query.awaitTermination()
        return [p.numInputRows > 0 for p in query.recentProgress].count(True)

    assert run() == 2
    early = alerts_in(spark, out)
    for part in (2, 3):
        (late / f"{part}.csv").rename(sample_folder / f"{part}.csv")
    assert run() == 2 and run() == 0
    want = first_alerts(spark, sample_folder, 28.0)
    assert early and early.items() <= want.items() and alerts_in(spark, out) == want


def test_no_alert_is_an_empty_table(spark, sample_folder, tmp_path):
    out = str(tmp_path / "out")
    live.run_saturation_alerts(
        samples(spark, sample_folder, True), out, threshold=100.0).awaitTermination()
    assert alerts_in(spark, out) == {}


def test_bins_hand_on_only_what_changed(spark, sample_folder, tmp_path, monkeypatch):
    """A batch with samples of one bin hands on that bin; the others keep their rows."""
    arriving(sample_folder)
    for part in (1, 2, 3):
        path = sample_folder / f"{part}.csv"
        path.write_text("".join(line for line in path.read_text().splitlines(True)
                                if line.startswith("timeS") or ",HTTP Request," in line
                                and 10 <= int(line.split(",")[4]) < 20 and line.count(",") == 5))
    handed, start = [], live._start

    def noting(df, mode, folder, write, once):
        def store(changed, batch_id):
            handed.append(sorted(r.user_bin for r in changed.collect()))
            write(changed, batch_id)
        return start(df, mode, folder, store, once)

    monkeypatch.setattr(live, "_start", noting)
    out = str(tmp_path / "out")
    live.run_user_bins(one_file_per_batch(spark, sample_folder, NAMES), out).awaitTermination()
    assert handed == [[0, 10, 20, 30], [10], [10], [10]]
    got = live.latest_batch(spark, f"{out}/bins").orderBy("user_bin").toPandas()
    want = capacity.bin_stats(capacity.thread_stats(samples(spark, sample_folder, False)))
    want = want.orderBy("user_bin").toPandas()[list(got.columns)]
    assert got.round(9).equals(want.round(9))


def test_settings_come_back_after_the_start(spark, sample_folder, tmp_path):
    before = {k: spark.conf.get(k, None) for k in live._STATE_STORE}
    live.run_saturation_alerts(
        samples(spark, sample_folder, True), str(tmp_path / "out")).awaitTermination()
    assert {k: spark.conf.get(k, None) for k in live._STATE_STORE} == before


def test_live_bins_update_mode(spark, sample_folder, tmp_path):
    out = str(tmp_path / "out")
    totals = []

    def note(df, _):
        totals.append({r.user_bin: r.total_requests for r in df.collect()})

    live._start(live.live_user_bins(samples(spark, sample_folder, True)), "update", out, note,
                True).awaitTermination()
    assert sum(totals[-1].values()) == 200


def test_host_windows_drop_late_rows(spark, tmp_path):
    folder = tmp_path / "host"
    folder.mkdir()
    base = int(T0.timestamp()) * 1000

    def write(name, rows):
        (folder / name).write_text("timestamp,memory_percent\n" + "".join(
            f"{base + s * 1000},{v}\n" for s, v in rows))

    names = ["timestamp", "memory_percent"]
    out = str(tmp_path / "out")
    write("0.csv", [(0, 10), (30, 20), (60, 30), (600, 40)])
    for name, rows in (("1.csv", []), ("2.csv", [(10, 99), (660, 50)]), ("3.csv", [(1200, 1)])):
        windows = live.live_host_metrics(
            stream_host_metrics(spark, str(folder), names), ["memory_percent"])
        live.run_append(windows, out).awaitTermination()
        write(name, rows)
    windows = live.live_host_metrics(
        stream_host_metrics(spark, str(folder), names), ["memory_percent"])
    live.run_append(windows, out).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").orderBy("window_start").collect()
    assert [(r.window_start, r.points, r.memory_percent_avg, r.memory_percent_max) for r in got] == [
        (T0, 2, 15.0, 20.0), (T0 + timedelta(seconds=60), 1, 30.0, 30.0),
        (T0 + timedelta(seconds=600), 1, 40.0, 40.0), (T0 + timedelta(seconds=660), 1, 50.0, 50.0)]


def test_dedup_keeps_one_per_question(spark, tmp_path):
    folder = str(tmp_path / "spans")
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("context.span_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("start_time"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("q"), F.col("id") % 50)).alias("question"))
    rows.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    live.run_append(live.live_dedup(stream, late="1 hour"), out).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").toPandas()
    want = {r.question for r in rows.select("question").distinct().collect()}
    assert got["question"].is_unique and set(got["question"]) == want


def test_other_header_stops_the_stream(spark, tmp_path):
    folder = tmp_path / "host"
    folder.mkdir()
    (folder / "a.csv").write_text("memory_percent,timestamp\n1,2\n")
    stream = stream_host_metrics(spark, str(folder), ["timestamp", "memory_percent"])
    with pytest.raises(Exception, match="header"):
        live.run_append(stream, str(tmp_path / "out")).awaitTermination()


def test_settings_of_the_caller_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    child = live.streaming_session(spark, 3)
    assert child.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    assert named is None or folder == named.rstrip("/")
