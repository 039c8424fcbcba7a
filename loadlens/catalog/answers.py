"""Queries of question extraction and answer evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.functions import text
from loadlens.operators import evaluate, qa
from loadlens.sources.writers import prompt_lines

_SPACE = " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)


def extract_qa(spark, sf):
    return qa.extract_qa(t.benchmark_lines(spark, sf))


def head_lines(spark, sf):
    return qa.extract_qa(t.benchmark_lines(spark, sf), 150).select("ord", "answer")


def parse_benchmark(spark, sf):
    return qa.parse_benchmark(t.benchmark_lines(spark, sf))


def prompt_file_lines(spark, sf):
    return prompt_lines(qa.extract_qa(t.benchmark_lines(spark, sf))).select("ord", "value")


def final_answer(spark, sf):
    doc = F.col("doc_id")
    marked = F.when(doc % 3 == 0, F.concat("text", F.lit(" ##### "), doc)).when(
        doc % 3 == 1, F.concat(F.lit("a#### "), F.col("text"), F.lit(" #### "), doc, F.lit("\t")),
    ).otherwise(F.col("text"))
    return t.table(spark, sf, "documents").select(
        "doc_id", text.final_answer(marked).alias("answer"))


_QA_SQL = f"""
lines AS (
  SELECT doc_id * {len(t.BAD_LINES) + 1} AS ord, trim(text, ws) AS question,
         trim(CASE WHEN doc_id % 5 = 0 THEN ' ' || n_chars
                   ELSE 'so #### 1 #### ' || n_chars || chr(10) END, ws) AS raw_answer,
         CAST(n_chars AS VARCHAR) AS answer
  FROM documents, (SELECT {_SPACE} AS ws)),
extracted AS (
  SELECT ord, question, answer, raw_answer,
         CASE WHEN contains(question, '"') OR contains(question, '\\')
                OR contains(question, chr(10)) OR contains(question, chr(13))
              THEN trim(replace(replace(replace(replace(question, '\\', '\\\\'), '"', '\\"'),
                        chr(13), ' '), chr(10), ' '), (SELECT {_SPACE}))
              ELSE question END AS prompt
  FROM lines WHERE question <> '')"""


def ground_truth(spark, sf):
    return t.truth(spark, sf)


def mark_duplicates(spark, sf):
    df = evaluate.mark_duplicates(t.spans(spark, sf), ["start_time", "context.span_id"])
    return df.select("ord", "question", "is_duplicate")


def attach_truth(spark, sf):
    return evaluate.attach_truth(t.spans(spark, sf), t.truth(spark, sf)).select(
        "ord", "question", "ground_truth")


def shape_spans(spark, sf):
    docs = t.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias(schemas.SPAN_INPUT),
        F.reverse("text").alias(schemas.SPAN_OUTPUT),
        (F.col("n_chars") / 7).alias(schemas.SPAN_SECONDS))
    shaped = evaluate.shape_spans(docs)
    return shaped.select(
        "doc_id", F.col(f"`{schemas.SPAN_INPUT}`").alias("input"),
        F.length(f"`{schemas.SPAN_OUTPUT}`").cast("long").alias("output_chars"),
        F.col(f"`{schemas.SPAN_SECONDS}`").alias("seconds"))


def extract_answer(spark, sf):
    return evaluate.extract_answer(t.spans(spark, sf)).select(
        "ord", "generated_answer", "extracted_answer")


_REPLY_SQL = """
CASE WHEN upper(trim(reply)) = 'NONE' THEN 'NONE'
     ELSE coalesce(nullif(regexp_extract(trim(reply), '\\b\\d+(?:\\.\\d+)?\\b', 0), ''), trim(reply))
END"""


def _replies(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    reply = (
        F.when(key % 7 == 0, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(key % 7 == 1, F.concat(F.lit("-"), price))
        .when(key % 7 == 2, F.concat(key, F.lit("abc")))
        .when(key % 7 == 3, F.lit("none "))
        .when(key % 7 == 4, F.concat(key, F.lit(",234")))
        .when(key % 7 == 5, F.concat(F.lit("it is $"), price, F.lit(".")))
        .otherwise(F.concat(F.lit("007"), key, F.lit(". no"))))
    return t.table(spark, sf, "orders").select(key, reply.alias("reply"))


_REPLIES_SQL = """
replies AS (
  SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 0 THEN ' ' || price || ' ' WHEN 1 THEN '-' || price WHEN 2 THEN o_orderkey || 'abc'
    WHEN 3 THEN 'none ' WHEN 4 THEN o_orderkey || ',234' WHEN 5 THEN 'it is $' || price || '.'
    ELSE '007' || o_orderkey || '. no' END AS reply
  FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price
        FROM orders))"""


def parse_reply(spark, sf):
    return _replies(spark, sf).select(
        "o_orderkey", text.parse_reply(F.col("reply")).alias("parsed"))


def reply_text(spark, sf):
    turn = F.col("turn")
    body = (
        F.when(turn % 4 == 0, F.to_json(F.struct(F.col("text").alias("response"))))
        .when(turn % 4 == 1, F.to_json(F.struct(
            F.lit("").alias("response"), F.array(F.struct("text")).alias("choices"))))
        .when(turn % 4 == 2, F.col("role"))
        .otherwise(F.to_json(F.struct("role"))))
    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.reply_text(body).alias("reply"))


def answer_key(spark, sf):
    key = text.answer_key(F.col("reply"))
    return _replies(spark, sf).select("o_orderkey", key.alias("key")).select("o_orderkey", "key.*")


def _evaluated(spark, sf):
    return evaluate.evaluate(t.spans(spark, sf), t.truth(spark, sf),
                             order_by=["start_time", "context.span_id"])


def evaluate_answers(spark, sf):
    return _evaluated(spark, sf).select("ord", "question", "correctness")


def evaluation_summary(spark, sf):
    return evaluate.evaluation_summary(_evaluated(spark, sf))


def evaluation_report(spark, sf):
    return evaluate.evaluation_report(_evaluated(spark, sf))


def span_latency(spark, sf):
    df = evaluate.span_latency(t.spans(spark, sf), ["span_kind", "status_code"])
    cols = ["mean_seconds", "median_seconds", "p95_seconds", "mean_duration_sec"]
    return df.withColumns({c: F.round(c, 6) for c in cols})


_RESULTS_SQL = t.SPANS_SQL + "," + t.QA_SQL + """,
extracted AS (
  SELECT *, coalesce(replace(list_last(regexp_extract_all(generated_answer,
              '\\d[\\d,]*(?:\\.\\d+)?')), ',', ''), 'NONE') AS reply,
         row_number() OVER (PARTITION BY question
                            ORDER BY start_time, CAST(ord AS VARCHAR)) AS occurrence
  FROM spans),
compared AS (
  SELECT e.*, ground_truth,
    CASE WHEN reply IN ('NONE', 'ERROR', '') THEN 's' || reply
         WHEN contains(reply, '.') THEN 'f' || CAST(CAST(reply AS DOUBLE) AS VARCHAR)
         ELSE 'i' || CAST(CAST(reply AS HUGEINT) AS VARCHAR) END AS given,
    CASE WHEN ground_truth = 'NONE' THEN 'sNONE' ELSE 'i' || ground_truth END AS wanted
  FROM extracted e LEFT JOIN truth USING (question)),
results AS (
  SELECT ord, question,
    CASE WHEN occurrence > 1 THEN 'DUPLICATE' WHEN ground_truth IS NULL THEN 'NO_GROUND_TRUTH'
         WHEN given = wanted THEN 'true' ELSE 'false' END AS correctness
  FROM compared),
tally AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE correctness <> 'DUPLICATE') AS questions,
         count(*) FILTER (WHERE correctness = 'DUPLICATE') AS duplicates,
         count(*) FILTER (WHERE correctness = 'true') AS correct,
         count(*) FILTER (WHERE correctness IN ('true', 'false')) AS evaluated
  FROM results)"""

QUERIES = {
    "extract_qa": Query(extract_qa, f"""WITH {_QA_SQL}
SELECT ord, question, answer, prompt FROM extracted"""),
    "head_lines": Query(head_lines, f"""WITH {_QA_SQL}
SELECT ord, answer FROM extracted WHERE ord IN (
  SELECT ord FROM (SELECT ord FROM lines UNION ALL SELECT ord + i FROM lines,
    (SELECT unnest(range(1, {len(t.BAD_LINES) + 1})) AS i)
    WHERE (ord // {len(t.BAD_LINES) + 1}) % 11 = 0)
  ORDER BY ord LIMIT 150)"""),
    "parse_benchmark": Query(parse_benchmark, f"""WITH {_QA_SQL}
SELECT ord, question, raw_answer AS answer FROM extracted"""),
    "prompt_file_lines": Query(prompt_file_lines, f"""WITH {_QA_SQL}
SELECT ord, regexp_replace(prompt, '([|\\\\"])', '\\\\\\1', 'g') AS value FROM extracted"""),
    "final_answer": Query(final_answer, f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# ' || doc_id WHEN 1 THEN CAST(doc_id AS VARCHAR)
       ELSE trim(text, {_SPACE}) END AS answer FROM documents"""),
    "ground_truth": Query(ground_truth, f"WITH {t.QA_SQL} SELECT * FROM truth"),
    "mark_duplicates": Query(mark_duplicates, f"""WITH {t.SPANS_SQL}
SELECT ord, question, row_number() OVER (PARTITION BY question
       ORDER BY start_time, CAST(ord AS VARCHAR)) > 1 AS is_duplicate FROM spans"""),
    "attach_truth": Query(attach_truth, f"""WITH {t.SPANS_SQL}, {t.QA_SQL}
SELECT ord, question, ground_truth FROM spans LEFT JOIN truth USING (question)"""),
    "shape_spans": Query(shape_spans, """
SELECT doc_id, substring(text, 1, 1000) AS input, least(length(text), 1000) AS output_chars,
       round(n_chars / 7.0::DOUBLE, 3) AS seconds FROM documents"""),
    "extract_answer": Query(extract_answer, f"""WITH {t.SPANS_SQL},
replied AS (
  SELECT *, coalesce(replace(list_last(regexp_extract_all(generated_answer,
              '\\d[\\d,]*(?:\\.\\d+)?')), ',', ''), 'NONE') AS reply FROM spans)
SELECT ord, generated_answer, {_REPLY_SQL} AS extracted_answer FROM replied"""),
    "parse_reply": Query(parse_reply, f"""WITH {_REPLIES_SQL}
SELECT o_orderkey, {_REPLY_SQL} AS parsed FROM replies"""),
    "reply_text": Query(reply_text, f"""
SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'ERROR' WHEN 3 THEN ''
       ELSE trim(text, {_SPACE}) END AS reply FROM conversations"""),
    "answer_key": Query(answer_key, f"""WITH {_REPLIES_SQL},
digits AS (SELECT *, regexp_replace(reply, '[^0-9.]', '', 'g') AS d FROM replies),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(d, '^([0-9]+\\.[0-9]*|\\.[0-9]+)$') THEN 'f'
                 WHEN regexp_matches(d, '^[0-9]+$') THEN 'i' ELSE 's' END AS kind FROM digits)
SELECT o_orderkey, kind, CASE WHEN kind = 'f' THEN TRY_CAST(d AS DOUBLE) END AS num,
       CASE kind WHEN 'i' THEN CAST(TRY_CAST(d AS HUGEINT) AS VARCHAR)
                 WHEN 's' THEN trim(reply) END AS text FROM kinds"""),
    "evaluate_answers": Query(evaluate_answers, f"WITH {_RESULTS_SQL} SELECT * FROM results"),
    "evaluation_summary": Query(evaluation_summary, f"""WITH {_RESULTS_SQL}
SELECT questions AS total_questions_processed, evaluated + duplicates AS total_rows_in_csv,
       duplicates AS duplicate_questions_skipped, correct AS correct_answers,
       questions - correct AS incorrect_answers,
       coalesce(round(correct / nullif(evaluated, 0)::DOUBLE * 100, 2), 0) AS accuracy_percentage
FROM tally"""),
    "evaluation_report": Query(evaluation_report, f"""WITH {_RESULTS_SQL}
SELECT n AS all_rows, duplicates AS duplicate_rows, questions AS unique_questions,
       evaluated AS questions_with_truth, correct, evaluated - correct AS incorrect,
       coalesce(round(correct / nullif(evaluated, 0)::DOUBLE * 100, 2), 0) AS accuracy_pct
FROM tally"""),
    "span_latency": Query(span_latency, f"""WITH {t.SPANS_SQL}
SELECT span_kind, status_code, count(*) AS spans, round(avg(seconds), 6) AS mean_seconds,
       round(quantile_cont(seconds, 0.5), 6) AS median_seconds,
       round(quantile_cont(seconds, 0.95), 6) AS p95_seconds,
       round(avg(epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS mean_duration_sec
FROM spans GROUP BY ALL"""),
}
