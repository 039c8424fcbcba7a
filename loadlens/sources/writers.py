"""Sinks.  Sorting happens here, never in the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.functions.text import json_escape, pipe_escape

# Columns the evaluation adds for its own use; they are not written.
_HELPERS = {
    "ord", "question", "generated_answer", "extracted_answer", "ground_truth",
    "correctness", "original_row",
}


# Fixed value: times in written files, without a zone (UTC).
_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", timestampFormat=_TIMES,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_user_bins(bins: DataFrame, path: str) -> None:
    """User bins as CSV, ordered by bin."""
    _write_csv(bins.orderBy("user_bin"), path)


def write_correlated(correlated: DataFrame, path: str, order_by: Sequence[str] = ("user_bin",)) -> None:
    """Correlated table as CSV."""
    _write_csv(correlated.orderBy(*order_by), path)


def prompt_lines(qa: DataFrame) -> DataFrame:
    """Each question as the line it takes in the prompt file."""
    return qa.withColumn("value", pipe_escape(json_escape(F.col("question"))))


def write_prompts(qa: DataFrame, path: str, order_by: str = "ord") -> None:
    """Prompts as an unquoted pipe-delimited file of one column, the header line first.

    Written as text, as the CSV sink quotes what needs escaping.
    """
    lines = prompt_lines(qa).select(F.lit(1).alias("_after"), order_by, "value")
    header = qa.sparkSession.range(1).select(
        F.lit(0).alias("_after"), F.lit("prompt").alias("value"))
    header.unionByName(lines, allowMissingColumns=True).orderBy("_after", order_by).select(
        "value").write.mode("overwrite").text(path)


def write_qa(qa: DataFrame, path: str, order_by: str = "ord") -> None:
    """Question and answer pairs as JSON lines, non-ASCII text kept."""
    qa.orderBy(order_by).select("question", "answer").write.mode("overwrite").json(path)


def result_columns(names: Sequence[str]) -> list[str]:
    """Known span columns first, other columns next, correctness last."""
    known = [n for n in schemas.SPAN_COLUMNS if n in names]
    other = [n for n in names if n not in known and n not in _HELPERS]
    return [*known, *other, "correctness"]


def write_results(results: DataFrame, path: str, order_by: str = "ord") -> None:
    """Evaluation results as CSV."""
    columns = [schemas.quoted(n) for n in result_columns(results.columns)]
    _write_csv(results.orderBy(order_by).select(*columns), path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One-row evaluation summary as JSON."""
    summary.write.mode("overwrite").json(path)


def export_spans(spans: DataFrame, path: str, limit: int | None = None,
                 order_by: str = "ord") -> None:
    """All spans as CSV, or with ``limit`` the first of them in ``order_by`` order."""
    rows = spans if limit is None else spans.orderBy(order_by).limit(limit)
    _write_csv(rows.drop("ord"), path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Trace dataset as Parquet."""
    traces.write.mode("overwrite").parquet(path)
