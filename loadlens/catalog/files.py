"""Queries that write a file format to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.catalog import Query, answers, correlation, corpus
from loadlens.catalog import tables as t
from loadlens.catalog.capacity import QUERIES as CAPACITY
from loadlens.operators import capacity, correlate, evaluate, qa, telemetry
from loadlens.operators import corpus as corpus_ops
from loadlens.sources import readers, writers
from loadlens.sources.store import new_folder

_ORDER = ["start_time", "context.span_id"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("avg_error_rate", "avg_elapsed")})


def load_samples_file(spark, sf):
    """Files of two layouts, one with another order of columns, with ragged rows beside them.

    Messages of failed requests hold quotes, commas and line breaks.
    """
    folder = new_folder(spark)
    samples = t.load_samples(spark, sf).drop("ord").withColumn("responseMessage", F.when(
        F.col("responseCode") != "200", F.concat("responseMessage", F.lit(', "again"\n\nlater')))
        .otherwise(F.col("responseMessage")))
    paths = []
    for run, names in ((0, samples.columns), (1, samples.columns[::-1] + ["host"]),
                       (2, samples.columns)):
        names = [n for n in names if n != "run_id"]
        cells = samples.filter(F.col("run_id") == run).select(*[
            F.lit("h, 1").alias(n) if n == "host" else
            F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])
        cells.write.csv(f"{folder}/run{run}", header=True, escape='"', quoteAll=True)
        # A row too long is dropped; one too short has no number to count.
        ragged = cells.limit(5).select(F.explode(F.array(
            F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(n, F.lit('"'), F.lit('""')),
                                        F.lit('"')) for n in names], F.lit("surplus")),
            F.lit("1,2"))).alias("value")).select(F.lit(1).alias("after"), "value")
        head = spark.range(1).select(F.lit(0).alias("after"), F.lit(",".join(names)).alias("value"))
        head.unionByName(ragged).coalesce(1).sortWithinPartitions("after").select(
            "value").write.text(f"{folder}/ragged{run}")
        paths += [f"{folder}/run{run}", f"{folder}/ragged{run}"]
    return _rounded(capacity.user_bins(capacity.prepare_samples(
        readers.read_load_samples(spark, paths))))


def user_bins_files(spark, sf):
    bins, folder = t.saved_run_bins(spark, sf), new_folder(spark)
    paths = [f"{folder}/run{i}" for i in range(3)]
    for i, path in enumerate(paths):
        writers.write_user_bins(bins.filter(F.col("run_id") == i).drop("run_id"), path)
    back = readers.read_user_bins(spark, paths).drop("ord")
    return _rounded(back).withColumn("run_id", F.col("run_id").cast("long"))


def run_windows_files(spark, sf):
    """Periods of runs whose files stand in falling order of users, beside files of no use."""
    bins, folder = t.saved_run_bins(spark, sf), new_folder(spark)
    for i in range(3):
        bins.filter(F.col("run_id") == i).drop("run_id").coalesce(1).sortWithinPartitions(
            F.desc("user_bin")).write.csv(f"{folder}/run{i}", header=True)
    spark.range(3).write.csv(f"{folder}/foreign", header=True)
    spark.range(1).select(F.lit("").alias("value")).write.text(f"{folder}/empty")
    paths = [f"{folder}/{name}" for name in (
        "run0", "run1", "run2", "foreign", "empty", "missing")]
    windows = correlate.run_windows(readers.read_user_bins(spark, paths))
    return windows.withColumn("run_id", F.col("run_id").cast("long"))


def host_metrics_file(spark, sf):
    """Two hosts: one reports a core less, in another order of columns."""
    path = new_folder(spark)
    host = t.host_metrics(spark, sf).drop(
        "ord", "run_id", "datetime", "time_str", "cpu_cores_sum")
    small = F.col("cpu_1_percent").isNull()
    host.filter(~small).write.csv(f"{path}/host=a", header=True)
    host.filter(small).select(*[c for c in host.columns[::-1] if c != "cpu_1_percent"]).write.csv(
        f"{path}/host=b", header=True)
    path = [f"{path}/host=a", f"{path}/host=b"]
    host = telemetry.cpu_cores_sum(telemetry.with_time(readers.read_host_metrics(spark, path)))
    return host.select("timestamp", "datetime", "cpu_cores_sum", "memory_percent",
                       "gpu_0_util_percent", "gpu_0_mem_used_mb")


def emissions_file(spark, sf):
    path = new_folder(spark)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t.emissions(spark, sf).drop("ord").withColumn("timestamp", iso).write.csv(path, header=True)
    return readers.read_emissions(spark, path).drop("ord")


def correlated_file(spark, sf):
    found, path = correlation._phase2(spark, sf), new_folder(spark)
    writers.write_correlated(found, path)
    return _rounded(spark.read.csv(path, schema=found.schema, header=True)).withColumn(
        "cpu_cores_count", F.col("cpu_cores_count").cast("long"))


def benchmark_file(spark, sf):
    path = new_folder(spark)
    t.benchmark_lines(spark, sf).select("value").write.text(path)
    return readers.read_benchmark(spark, path).drop("ord")


def prompts_file(spark, sf):
    path = new_folder(spark)
    writers.write_prompts(qa.extract_qa(t.benchmark_lines(spark, sf)), path)
    return spark.read.text(path).filter("value <> 'prompt'")


def qa_file(spark, sf):
    path = new_folder(spark)
    writers.write_qa(qa.extract_qa(t.benchmark_lines(spark, sf)), path)
    return readers.read_qa(spark, path).drop("ord")


def results_file(spark, sf):
    """Spans from a file, evaluated, and the results read back from their file."""
    folder = new_folder(spark)
    exported = t.spans(spark, sf).drop("ord", "question", "generated_answer")
    writers.export_spans(exported, f"{folder}/spans", limit=None)
    spans = readers.read_spans(spark, f"{folder}/spans")
    results = evaluate.evaluate(spans, t.truth(spark, sf), order_by=_ORDER)
    writers.write_results(results, f"{folder}/results")
    back = spark.read.csv(f"{folder}/results", header=True, multiLine=True, escape='"')
    return back.select(
        F.col("`context.span_id`").cast("long").alias("ord"),
        F.btrim(f"`{schemas.SPAN_INPUT}`").alias("question"), "correctness")


def export_spans(spark, sf):
    path = new_folder(spark)
    writers.export_spans(t.spans(spark, sf), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False,
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = {"span_kind": "span_kind", "start_time": "start_time", "status_code": "status_code",
             "question": "question", "generated_answer": "generated_answer",
             "span_id": "`context.span_id`"}
    # The test table has whole seconds.
    return back.select(*[F.col(c).alias(n) for n, c in cells.items()]).withColumn(
        "start_time", F.date_format(F.to_timestamp("start_time"), "yyyy-MM-dd HH:mm:ss"))


def summary_file(spark, sf):
    path = new_folder(spark)
    writers.write_summary(answers.evaluation_summary(spark, sf), path)
    return spark.read.json(path)


def traces_file(spark, sf):
    path = new_folder(spark)
    writers.write_traces(t.spans(spark, sf), path)
    return spark.read.parquet(path).select("ord", "question", "generated_answer")


def chat_file(spark, sf):
    path = new_folder(spark)
    chats = corpus_ops.collect_conversations(t.turns(spark, sf))
    chats.select("conversations").write.json(path)
    return corpus_ops.to_chat_messages(readers.read_chat(spark, path, multi_line=False)).select(
        F.to_json("messages").alias("messages"))


def _only(sql: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({sql})"


QUERIES = {
    "load_samples_file": Query(load_samples_file, CAPACITY["user_bins"].sql),
    "user_bins_files": Query(user_bins_files, CAPACITY["user_bins_by_run"].sql),
    "run_windows_files": Query(run_windows_files, f"""WITH {t.RUN_BINS_SQL},
starts AS (SELECT run_id, arg_max(bin_start_timestamp, user_bin) AS run_start
           FROM bins GROUP BY run_id)
SELECT run_id, run_start, lead(run_start) OVER (ORDER BY run_id) - INTERVAL 300 SECOND AS run_end
FROM starts"""),
    "host_metrics_file": Query(host_metrics_file, f"""WITH {t.HOST_SQL}
SELECT timestamp, datetime, cpu_cores_sum, memory_percent, gpu_0_util_percent, gpu_0_mem_used_mb
FROM host"""),
    "emissions_file": Query(emissions_file, f"WITH {t.EMISSIONS_SQL} SELECT * EXCLUDE (ord) FROM emis"),
    "correlated_file": Query(correlated_file, correlation.QUERIES["correlate_phase2"].sql),
    "benchmark_file": Query(
        benchmark_file, _only(answers.QUERIES["parse_benchmark"].sql, "question, answer")),
    "prompts_file": Query(
        prompts_file, _only(answers.QUERIES["prompt_file_lines"].sql, "value")),
    "qa_file": Query(qa_file, _only(answers.QUERIES["extract_qa"].sql, "question, answer")),
    "results_file": Query(results_file, answers.QUERIES["evaluate_answers"].sql),
    "export_spans": Query(export_spans, f"""WITH {t.SPANS_SQL}
SELECT span_kind, CAST(start_time AS VARCHAR) AS start_time, status_code, question,
       generated_answer, CAST(ord AS VARCHAR) AS span_id FROM spans"""),
    "summary_file": Query(summary_file, answers.QUERIES["evaluation_summary"].sql),
    "traces_file": Query(traces_file, f"""WITH {t.SPANS_SQL}
SELECT ord, question, generated_answer FROM spans"""),
    "chat_file": Query(chat_file, corpus.QUERIES["to_chat_messages"].sql),
}
