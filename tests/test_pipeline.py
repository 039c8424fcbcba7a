"""The whole way from files to results, as the README shows it."""

import csv
from datetime import datetime, timedelta

import pandas as pd
import pytest

from loadlens import schemas
from loadlens.operators import capacity, correlate, corpus, evaluate, qa, telemetry
from loadlens.sources import readers, writers

START = datetime(2024, 1, 1)


def ms(seconds):
    return int((START - datetime(1970, 1, 1)).total_seconds() + seconds) * 1000


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for run, offset in enumerate((0, 7200)):
        with open(folder / f"run{run}.jtl", "w", newline="") as f:
            out = csv.DictWriter(f, schemas.SAMPLE_COLUMNS)
            out.writeheader()
            for i in range(600):  # 100 users more every 100 seconds, failing from 400 on
                users = 100 + i // 100 * 100 + i % 3
                bad = users >= 400 and i % 5 == 0
                out.writerow(dict.fromkeys(schemas.SAMPLE_COLUMNS, "") | {
                    "timeStamp": ms(offset + i), "elapsed": 100 + users, "Latency": 90,
                    "label": "HTTP Request", "responseCode": "500" if bad else "200",
                    "success": str(not bad).lower(), "allThreads": users,
                    "responseMessage": "failed, \"badly\"\nindeed" if bad else "OK"})
    rows = [{"timestamp": ms(s), "cpu_percent_total": 1, "memory_percent": s / 100,
             "gpu_0_util_percent": 5, "gpu_0_mem_used_mb": 6, "cpu_0_percent": 1.0,
             "cpu_1_percent": 2.0} for s in range(0, 9000, 30)]
    pd.DataFrame(rows).to_csv(folder / "system_metrics.csv", index=False)
    return folder


def test_load_test_to_correlation(spark, files, tmp_path):
    stats = []
    for run in range(2):
        raw = readers.read_load_samples(spark, str(files / f"run{run}.jtl"))
        bins = capacity.user_bins(capacity.prepare_samples(raw))
        assert capacity.nmax(bins).head().nmax == 400
        stats.append(str(tmp_path / f"run{run}_stats"))
        writers.write_user_bins(bins, stats[-1])
    runs = readers.read_user_bins(spark, stats)
    host = telemetry.with_time(readers.read_host_metrics(spark, str(files / "system_metrics.csv")))
    found = correlate.concat_runs(
        correlate.correlate_host(runs, host, order_by=["ord"], tolerance=30))
    got = found.orderBy("run_id", "user_bin").collect()
    assert [(r.run_id, r.user_bin, r.global_users) for r in got] == [
        (run, users, users + 600 * run) for run in range(2) for users in range(100, 700, 100)]
    assert [r.cpu_usage for r in got] == [3.0] * 12
    # Run 0 reaches 200 users at second 100; the rows at 90 and 120 are 10 and 20 s away.
    assert got[1].memory_percent == 0.9
    starts = telemetry.snap_run_starts(telemetry.run_starts(runs, "ord"), host)
    assert [r.marker for r in starts.orderBy("run_id").collect()] == [
        START, START + timedelta(seconds=7200)]
    smooth = telemetry.moving_average(
        telemetry.cpu_cores_sum(host), ["memory_percent"], ["datetime", "ord"])
    first = smooth.orderBy("datetime").head()
    assert first.memory_percent_ma == pytest.approx(0.3)
    series = correlate.correlation_series(found, schemas.CORRELATED_HOST_METRICS)
    assert series.count() == 12 * 6


def test_benchmark_to_accuracy(spark, tmp_path):
    path = tmp_path / "bench.jsonl"
    path.write_text("".join(
        f'{{"question": "what is {i} \\"plus\\" 1?", "answer": "add #### {i + 1}"}}\n'
        for i in range(20)))
    pairs = qa.extract_qa(readers.read_lines(spark, str(path)), 15)
    writers.write_qa(pairs, str(tmp_path / "qa"))
    frame = pd.DataFrame([
        dict.fromkeys(schemas.SPAN_COLUMNS, "") | {
            schemas.SPAN_INPUT: f'what is {i % 18} "plus" 1?',
            schemas.SPAN_OUTPUT: f"first {i},\nso {i % 18 + 1 + (i % 4 == 0)}"} for i in range(25)])
    frame.to_csv(tmp_path / "spans.csv", index=False)
    truth = evaluate.ground_truth(readers.read_qa(spark, str(tmp_path / "qa")))
    results = evaluate.evaluate(readers.read_spans(spark, str(tmp_path / "spans.csv")), truth)
    # 25 rows over 18 questions, 15 with truth, of which 0, 4, 8 and 12 are answered wrongly.
    assert evaluate.evaluation_summary(results).head().asDict() == {
        "total_questions_processed": 18, "total_rows_in_csv": 22, "duplicate_questions_skipped": 7,
        "correct_answers": 11, "incorrect_answers": 7, "accuracy_percentage": 73.33}


def test_corpus_to_tensors(spark, tmp_path):
    path = tmp_path / "chat.json"
    path.write_text('[{"conversations": [{"from": "human", "value": "a b"}, '
                    '{"from": "gpt", "value": "c"}]}]')
    rows = corpus.with_labels(corpus.pad_truncate(corpus.tokenise(corpus.render_chat(
        corpus.to_chat_messages(readers.read_chat(spark, str(path)))))), mask_pads=True)
    row = rows.head()
    assert sum(row.attention_mask) == 5 and len(row.input_ids) == 512
    assert row.labels[:5] == row.input_ids[:5] and set(row.labels[5:]) == {-100}
