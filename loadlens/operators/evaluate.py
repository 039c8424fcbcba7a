"""Answer evaluation: de-duplicate, look up truth, extract, compare, summarise.

Rows carry ``question`` and ``generated_answer``, not null (see ``keep_answered``).
``order_by`` names the columns that give file order and identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import schemas
from loadlens.functions.numbers import micros
from loadlens.functions.text import FAILED, last_number, parse_reply, same_answer
from loadlens.sources.store import stored

Extractor = Callable[[Column], Column]


# Minima of these are kept in place by a hash aggregate.
_FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DateType, T.TimestampType, T.TimestampNTZType)


def ground_truth(qa: DataFrame, order_by: str = "ord") -> DataFrame:
    """One truth per question; the last one wins.

    Order values should be unique.  Of rows that share the last one, the greatest answer counts.
    """
    kind = qa.schema[order_by].dataType
    if not isinstance(kind, _FIXED_WIDTH):
        return qa.groupBy("question").agg(
            F.max(F.struct(order_by, "answer"))["answer"].alias("ground_truth"))
    last = qa.groupBy(F.col("question").alias("_q")).agg(F.max(order_by).alias("_last"))
    # One row a question is left, so sorting them by answer is no burden.
    return qa.join(last, (F.col("question") == F.col("_q")) & F.col(order_by).eqNullSafe(
        F.col("_last"))).groupBy("question").agg(F.max("answer").alias("ground_truth"))


def _with_order(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [f"_o{i}" for i in range(len(order_by))]
    return df.withColumns({k: F.col(schemas.quoted(c)) for k, c in zip(keys, order_by)}), keys


def first_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first order keys of each question and the number of rows ``_n`` that have them.

    A missing key comes last.  The minimum of the first key combines map-side, so a question
    with many rows costs one row per task; only rows that share it are looked at for the other
    keys.
    """
    asked = rows.filter("question is not null").select("question", *keys)
    first, *rest = keys
    if isinstance(rows.schema[first].dataType, _FIXED_WIDTH):
        low = asked.groupBy(F.col("question").alias("_q")).agg(F.min(first).alias("_low"))
        asked = asked.join(low, (F.col("question") == F.col("_q")) & F.col(first).eqNullSafe(
            F.col("_low"))).drop("_q", "_low")
    else:
        rest = keys
    places = asked.groupBy("question", *keys).agg(F.count(F.lit(1)).alias("_n"))
    if not rest:
        return places
    order = Window.partitionBy("question").orderBy(*[F.asc_nulls_last(k) for k in rest])
    return places.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop(
        "_place")


def _firsts(
    spans: DataFrame, order_by: Sequence[str], truth: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first row of each question, with ``_truth`` if given, and all other rows.

    Rows meet their question's first keys, one row per question, which are stored: their true
    size decides whether they are broadcast.  Both results share that join's shuffle.  Of rows
    with equal keys one is taken, by the hash of its columns; equal rows are interchangeable.
    """
    rows, keys = _with_order(spans, order_by)
    firsts = first_rows(rows, keys)
    if truth is not None:
        answers = truth.select(F.col("question").alias("_t"), F.col("ground_truth").alias("_truth"))
        firsts = firsts.join(answers, F.col("question") == F.col("_t"), "left").drop("_t")
    firsts = stored(firsts.withColumnsRenamed({k: f"{k}_r" for k in ("question", *keys)}))
    on = [F.col("question") == F.col("question_r")] + [
        F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    met = rows.join(firsts, on, "left").drop(
        *keys, "question_r", *[f"{k}_r" for k in keys])
    hits, others = met.filter("_n is not null"), met.filter("_n is null")
    if firsts.filter("_n > 1").limit(1).count():
        order = Window.partitionBy("question").orderBy(F.xxhash64(
            *[schemas.quoted(c) for c in spans.columns]))
        placed = hits.withColumn("_place", F.row_number().over(order))
        others = others.unionByName(placed.filter("_place > 1").drop("_place"))
        hits = placed.filter("_place = 1").drop("_place")
    return hits.drop("_n"), others.drop("_n")


def mark_duplicates(spans: DataFrame, order_by: Sequence[str] = ("ord",)) -> DataFrame:
    """All rows, with ``is_duplicate`` true for all but the first of each question."""
    hits, others = _firsts(spans, order_by)
    return hits.withColumn("is_duplicate", F.lit(False)).unionByName(
        others.withColumn("is_duplicate", F.lit(True)))


def attach_truth(spans: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``ground_truth`` by question, missing where there is none."""
    return spans.join(truth, "question", "left")


def shape_spans(df: DataFrame, length: int = 1000) -> DataFrame:
    """Spans as the tracer stores them: texts cut to ``length``, seconds to 3 decimals."""
    changes = {
        name: F.substring(F.col(schemas.quoted(name)), 1, length)
        for name in (schemas.SPAN_INPUT, schemas.SPAN_OUTPUT)
    }
    changes[schemas.SPAN_SECONDS] = F.round(F.col(schemas.quoted(schemas.SPAN_SECONDS)), 3)
    return df.withColumns(changes)


def extract_answer(
    df: DataFrame, extractor: Extractor = last_number, text: str = "generated_answer"
) -> DataFrame:
    """Add ``extracted_answer``: the extractor's reply to each text, post-processed.

    ``extractor`` maps a column to a column: an expression, or a (pandas) UDF that
    asks a model.  A missing reply counts as failed.
    """
    reply = F.coalesce(extractor(F.col(text)), F.lit(FAILED))
    return df.withColumn("_reply", reply).withColumn(
        "extracted_answer", parse_reply(F.col("_reply"))).drop("_reply")


def evaluate(
    spans: DataFrame,
    truth: DataFrame,
    extractor: Extractor = last_number,
    order_by: Sequence[str] = ("ord",),
) -> DataFrame:
    """All spans with ``correctness``: true, false, DUPLICATE or NO_GROUND_TRUTH.

    The extractor sees one row per question with a truth and nothing else, once.
    """
    hits, others = _firsts(spans, order_by, truth)
    verdict = same_answer(F.col("extracted_answer"), F.col("_truth"))
    labels = {
        "correctness": F.when(verdict, schemas.CORRECT).otherwise(schemas.WRONG)}
    scored = extract_answer(hits.filter("_truth is not null"), extractor).withColumns(
        labels).drop("extracted_answer")
    unknown = hits.filter("_truth is null").withColumn("correctness", F.lit(schemas.NO_TRUTH))
    again = others.withColumn("correctness", F.lit(schemas.DUPLICATE))
    return scored.unionByName(unknown).unionByName(again).drop("_truth")


def _tally() -> dict[str, Column]:
    label = F.col("correctness")
    return {
        "questions": F.count_if(label != schemas.DUPLICATE),
        "duplicates": F.count_if(label == schemas.DUPLICATE),
        "correct": F.count_if(label == schemas.CORRECT),
        "evaluated": F.count_if(label.isin(schemas.CORRECT, schemas.WRONG)),
    }


def _accuracy(correct: Column, evaluated: Column) -> Column:
    return F.coalesce(F.round(correct / F.nullif(evaluated, F.lit(0)) * 100, 2), F.lit(0.0))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row of counters.

    Rows without truth are left out of ``total_rows_in_csv`` and counted among the
    incorrect answers; :func:`evaluation_report` has the plain totals.
    """
    t = _tally()
    return results.agg(
        t["questions"].alias("total_questions_processed"),
        (t["evaluated"] + t["duplicates"]).alias("total_rows_in_csv"),
        t["duplicates"].alias("duplicate_questions_skipped"),
        t["correct"].alias("correct_answers"),
        (t["questions"] - t["correct"]).alias("incorrect_answers"),
        _accuracy(t["correct"], t["evaluated"]).alias("accuracy_percentage"))


def evaluation_report(results: DataFrame) -> DataFrame:
    """One row of plain totals."""
    t = _tally()
    return results.agg(
        F.count(F.lit(1)).alias("all_rows"),
        t["duplicates"].alias("duplicate_rows"),
        t["questions"].alias("unique_questions"),
        t["evaluated"].alias("questions_with_truth"),
        t["correct"].alias("correct"),
        (t["evaluated"] - t["correct"]).alias("incorrect"),
        _accuracy(t["correct"], t["evaluated"]).alias("accuracy_pct"))


def span_latency(df: DataFrame, by: Sequence[str] = ("name", "status_code")) -> DataFrame:
    """Generation seconds and span duration per span kind, with exact percentiles.

    Seconds are taken to the 3 decimals their producer writes and counted per value first, so a
    large group arrives as a histogram of milliseconds.
    """
    seconds = F.round(F.col(schemas.quoted(schemas.SPAN_SECONDS)).cast("double"), 3)
    duration = micros("end_time") - micros("start_time")
    counted = df.groupBy(*by, seconds.alias("seconds")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(duration).alias("duration_us"),
        F.count(duration).alias("timed"))
    return counted.groupBy(*by).agg(
        F.sum("n").alias("spans"),
        (F.sum(F.col("seconds") * F.col("n")) /
         F.sum(F.when(F.col("seconds").isNotNull(), F.col("n")))).alias("mean_seconds"),
        F.percentile("seconds", F.lit(0.5), F.col("n")).alias("median_seconds"),
        F.percentile("seconds", F.lit(0.95), F.col("n")).alias("p95_seconds"),
        (F.sum("duration_us") / F.sum("timed") / 1e6).alias("mean_duration_sec"))
