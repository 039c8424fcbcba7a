"""The library's input tables as views of the test tables, in Spark and as SQL.

Each function and the SQL text of the same name compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadlens import schemas
from loadlens.operators import capacity, evaluate, telemetry
from loadlens.sources.readers import keep_answered
from loadlens.sources.store import stored


_LAYOUTS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False,
          per_batch: int | None = None) -> DataFrame:
    """One test table, as a stream if asked, of ``per_batch`` files at a time; times are UTC.

    The layout is read from the file footer once per process.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    if path not in _LAYOUTS:
        _LAYOUTS[path] = spark.read.parquet(path).schema
    if not stream:
        return spark.read.schema(_LAYOUTS[path]).parquet(path)
    # A streaming source takes a pattern, not a file; this one matches that file alone.
    reader = spark.readStream.schema(_LAYOUTS[path])
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark: SparkSession, sf_dir: str, stream: bool = False,
            per_batch: int | None = None) -> DataFrame:
    return (
        table(spark, sf_dir, "events", stream, per_batch)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long"))
    )


def run_of(ts) -> F.Column:
    """Run 0, 1 or 2 by day of month: 1-10, 11-20, 21 on."""
    return F.least(F.lit(2), F.floor((F.dayofmonth(ts) - 1) / 10)).cast("long")


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(least(2, (day(ts) - 1) // 10) AS BIGINT) AS run_id
  FROM events)"""


def load_samples(spark: SparkSession, sf_dir: str, stream: bool = False,
                 per_batch: int | None = None) -> DataFrame:
    """Raw load samples under the load tool's column names."""
    failed = F.col("event_type") == "error"
    hundredths = F.floor(F.col("value") * 100 + 0.5)
    return _events(spark, sf_dir, stream, per_batch).select(
        F.col("event_id").alias("ord"),
        run_of(F.col("ts")).alias("run_id"),
        F.unix_millis("ts").alias("timeStamp"),
        hundredths.alias("elapsed"),
        F.when(F.col("event_type") == "signup", "Debug Sampler")
        .otherwise(schemas.HTTP_SAMPLER).alias("label"),
        F.when(failed, "500").otherwise("200").alias("responseCode"),
        F.when(failed, "Internal Server Error").otherwise("OK").alias("responseMessage"),
        F.when(failed, "false").otherwise("true").alias("success"),
        (F.col("k") + 100).alias("bytes"),
        (F.col("k") + 50).alias("sentBytes"),
        F.col("user_id").alias("allThreads"),
        hundredths.alias("Latency"),
    )


SAMPLES_SQL = EVENTS_SQL + """,
raw AS (
  SELECT event_id AS ord, run_id, epoch_us(ts) // 1000 AS timestamp,
         CAST(round(value * 100) AS BIGINT) AS elapsed,
         CASE WHEN event_type = 'signup' THEN 'Debug Sampler' ELSE 'HTTP Request' END AS label,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS responsecode,
         CASE WHEN event_type = 'error' THEN 'Internal Server Error' ELSE 'OK' END
           AS responsemessage,
         CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END AS success,
         k + 100 AS bytes, k + 50 AS sentbytes, user_id AS allthreads,
         CAST(round(value * 100) AS BIGINT) AS latency
  FROM ev),
clean AS (
  SELECT * REPLACE (make_timestamp(timestamp * 1000) AS timestamp, success = 'true' AS success)
  FROM raw WHERE label = 'HTTP Request')"""


def clean_samples(spark: SparkSession, sf_dir: str, stream: bool = False,
                  per_batch: int | None = None) -> DataFrame:
    return capacity.prepare_samples(load_samples(spark, sf_dir, stream, per_batch))


STATS_SQL = SAMPLES_SQL + """,
stats AS (
  SELECT allthreads, count(*) AS total_requests,
         count(*) FILTER (WHERE NOT success) AS failed_requests,
         100.0 * count(*) FILTER (WHERE NOT success) / count(*) AS error_rate,
         avg(elapsed) AS avg_elapsed, min(timestamp) AS first_timestamp
  FROM clean GROUP BY allthreads),
bins AS (
  SELECT (allthreads // 10) * 10 AS user_bin, min(first_timestamp) AS bin_start_timestamp,
         avg(error_rate) AS avg_error_rate, avg(avg_elapsed) AS avg_elapsed,
         count(*) AS request_count
  FROM stats GROUP BY ALL)"""


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.user_bins(clean_samples(spark, sf_dir))


def saved_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User bins as the capacity step leaves them on disk for later steps."""
    return stored(bins(spark, sf_dir))


RUN_BINS_SQL = SAMPLES_SQL + """,
run_stats AS (
  SELECT run_id, allthreads,
         100.0 * count(*) FILTER (WHERE NOT success) / count(*) AS error_rate,
         avg(elapsed) AS avg_elapsed, min(timestamp) AS first_timestamp
  FROM clean GROUP BY ALL),
bins AS (
  SELECT run_id, (allthreads // 10) * 10 AS user_bin,
         min(first_timestamp) AS bin_start_timestamp,
         avg(error_rate) AS avg_error_rate, avg(avg_elapsed) AS avg_elapsed,
         count(*) AS request_count
  FROM run_stats GROUP BY ALL)"""


def run_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.user_bins(clean_samples(spark, sf_dir), by=["run_id"])


def saved_run_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(run_bins(spark, sf_dir))


def host_metrics(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Host metrics: two cores, memory and one GPU, from the view events."""
    raw = _events(spark, sf_dir, stream).filter("event_type = 'view'").select(
        F.col("event_id").alias("ord"),
        run_of(F.col("ts")).alias("run_id"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("value").alias("cpu_percent_total"),
        (F.col("value") * 0.5).alias("cpu_0_percent"),
        F.when(F.col("k") % 5 != 0, F.col("k").cast("double")).alias("cpu_1_percent"),
        F.col("k").cast("double").alias("memory_percent"),
        F.floor(F.col("value") * 0.25).cast("double").alias("gpu_0_util_percent"),
        F.floor(F.col("value") * 8).cast("double").alias("gpu_0_mem_used_mb"),
    )
    return telemetry.cpu_cores_sum(telemetry.with_time(raw))


HOST_SQL = EVENTS_SQL + """,
host AS (
  SELECT event_id AS ord, run_id, epoch_us(ts) // 1000 AS timestamp,
         make_timestamp(epoch_us(ts) // 1000 * 1000) AS datetime, value AS cpu_percent_total,
         value * CAST(0.5 AS DOUBLE) AS cpu_0_percent,
         CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS cpu_1_percent,
         CAST(k AS DOUBLE) AS memory_percent,
         floor(value * CAST(0.25 AS DOUBLE)) AS gpu_0_util_percent,
         floor(value * 8) AS gpu_0_mem_used_mb,
         value * CAST(0.5 AS DOUBLE)
           + CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) ELSE 0 END AS cpu_cores_sum
  FROM ev WHERE event_type = 'view')"""

# Factor of the event value that stands in for each emission metric.
_FACTORS = {m: 2.0 ** (i - 4) for i, (m, _, _) in enumerate(schemas.EMISSION_METRICS)}


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions from the purchase events, each metric a fixed multiple of the value."""
    return _events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("ord"), F.col("ts").alias("timestamp"),
        *[(F.col("value") * F.lit(f)).alias(m) for m, f in _FACTORS.items()])


EMISSIONS_SQL = EVENTS_SQL + """,
emis AS (
  SELECT event_id AS ord, ts AS timestamp,
         """ + ", ".join(f"value * CAST({f} AS DOUBLE) AS {m}" for m, f in _FACTORS.items()) + """
  FROM ev WHERE event_type = 'purchase')"""


def spans(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Trace spans from orders: the customer is the question, so questions repeat.

    Every seventh order asks what no customer does; every fifth row comes twice.  Seconds are
    not rounded.
    """
    key, number = F.col("o_orderkey"), F.floor(F.col("o_totalprice")).cast("long") % 5
    price = F.floor(F.col("o_totalprice")).cast("long").cast("string")
    answer = (
        F.when(key % 6 == 0, F.concat(F.lit("Step 1 gives 7.\nThe answer is "), number, F.lit("\n")))
        .when(key % 6 == 1, F.concat(F.lit("It costs $"), price, F.lit(",000 or ~"), number))
        .when(key % 6 == 2, F.concat(F.lit("So x = "), number, F.lit(".0")))
        .when(key % 6 == 3, F.lit("I cannot tell"))
        .when(key % 6 == 4, F.concat(F.lit("00"), number, F.lit(" ")))
        .otherwise(F.concat(F.lit("between 1 and "), number))
    )
    raw = table(spark, sf_dir, "orders", stream).select(
        key.alias("ord"),
        F.lit("generate").alias("name"),
        F.col("o_orderpriority").alias("span_kind"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp"))
                           + (key % 977 + 1) * 1000).alias("end_time"),
        F.col("o_orderstatus").alias("status_code"),
        key.cast("string").alias("context.span_id"),
        answer.alias(schemas.SPAN_OUTPUT),
        ((key % 977 + 1) / 1000 + (key % 89) / 1e7).alias(schemas.SPAN_SECONDS),
        F.concat(F.when(key % 7 == 3, F.lit(" x")).otherwise(F.lit(" q")), F.col("o_custkey"))
        .alias(schemas.SPAN_INPUT),
        F.explode(F.when(key % 5 == 2, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
    return keep_answered(raw)


SPANS_SQL = """
spans AS (
  SELECT o_orderkey AS ord, o_orderpriority AS span_kind, o_orderdate AS start_time,
         o_orderdate + to_milliseconds(o_orderkey % 977 + 1) AS end_time,
         o_orderstatus AS status_code,
         (o_orderkey % 977 + 1) / 1000.0::DOUBLE AS seconds,
         CASE WHEN o_orderkey % 7 = 3 THEN 'x' ELSE 'q' END || o_custkey AS question,
         trim(CASE o_orderkey % 6
           WHEN 0 THEN 'Step 1 gives 7.' || chr(10) || 'The answer is ' || n || chr(10)
           WHEN 1 THEN 'It costs $' || price || ',000 or ~' || n
           WHEN 2 THEN 'So x = ' || n || '.0'
           WHEN 3 THEN 'I cannot tell'
           WHEN 4 THEN '00' || n || ' '
           ELSE 'between 1 and ' || n END, ' ' || chr(10)) AS generated_answer
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price,
               CAST(floor(o_totalprice) AS BIGINT) % 5 AS n,
               unnest(CASE WHEN o_orderkey % 5 = 2 THEN [0, 1] ELSE [0] END) AS copy
        FROM orders))"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth pairs from customers: every third comes twice."""
    key = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(
        (key * 2).alias("ord"), F.concat(F.lit("q"), key).alias("question"),
        F.when(key % 10 == 9, F.lit("NONE"))
        .otherwise((key % 5).cast("string")).alias("answer"))
    again = pairs.filter((F.col("ord") / 2) % 3 == 0).select(
        (F.col("ord") + 1).alias("ord"), "question",
        (F.col("ord") / 2 % 4).cast("long").cast("string").alias("answer"))
    return pairs.unionByName(again)


QA_SQL = """
pairs AS (
  SELECT c_custkey * 2 AS ord, 'q' || c_custkey AS question,
         CASE WHEN c_custkey % 10 = 9 THEN 'NONE'
              ELSE CAST(c_custkey % 5 AS VARCHAR) END AS answer, c_custkey
  FROM customer),
qa AS (
  SELECT ord, question, answer FROM pairs
  UNION ALL
  SELECT ord + 1, question, CAST(c_custkey % 4 AS VARCHAR) FROM pairs WHERE c_custkey % 3 = 0),
truth AS (
  SELECT question, max_by(answer, ord) AS ground_truth FROM qa GROUP BY question)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ground_truth(qa(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the speaker names of the chat corpus."""
    speaker = F.when(F.col("role") == "user", "human").when(
        F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", speaker.alias("from"), F.col("text").alias("value"))


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines from documents: the text is the question, its length the truth.

    Bad lines are added behind every 11th.
    """
    doc = F.col("doc_id")
    answer = F.when(doc % 5 == 0, F.concat(F.lit(" "), F.col("n_chars"))).otherwise(
        F.concat(F.lit("so #### 1 #### "), F.col("n_chars"), F.lit("\n")))
    line = F.to_json(F.struct(F.col("text").alias("question"), answer.alias("answer")))
    lines = table(spark, sf_dir, "documents").select(
        (doc * (len(BAD_LINES) + 1)).alias("ord"), line.alias("value"))
    places = F.posexplode(F.array(*map(F.lit, BAD_LINES))).alias("at", "value")
    bad = lines.filter(F.col("ord") / (len(BAD_LINES) + 1) % 11 == 0).select("ord", places)
    return lines.unionByName(bad.select((F.col("ord") + F.col("at") + 1).alias("ord"), "value"))


# Lines that are no JSON object, or more than one.
BAD_LINES = [
    "  ", "cut sho", '{"question":"a","answer":"b"', '{"question":"a","answer":"b"} {"x":1}',
    '{"question":"a","answer":"b"}}', '{"question":"a","answer":"b"} more}',
    "{'question':'a','answer':'b'}", '{"question":"a\tb","answer":"c"}',
    '{"question":"a","answer":"b"},{"question":"c","answer":"d"}',
    '{"question":"a","answer":"b"}],[{"x":1}', '[{"question":"a","answer":"b"}]',
    '{question:"a","answer":"b"}', '{"question":"a","answer":"b",}',
    '{"question":"","answer":"b"}', '{"question":"a"}', "null",
]
