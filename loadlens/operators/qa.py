"""Question and answer extraction from benchmark lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions.text import final_answer, json_escape
from loadlens.sources.readers import parse_benchmark


def head_lines(lines: DataFrame, n: int = 100, order_by: Sequence[str] = ("ord",)) -> DataFrame:
    """The first ``n`` physical lines; blank and invalid ones count."""
    return lines.orderBy(*order_by).limit(n)


def extract_qa(
    lines: DataFrame, n: int | None = None, order_by: Sequence[str] = ("ord",)
) -> DataFrame:
    """Questions with ground truth and escaped prompt, duplicates kept.

    ``lines`` holds JSON documents as ``value``; ``n`` limits the lines looked at.
    Both output files are projections of this one table.
    """
    taken = lines if n is None else head_lines(lines, n, order_by)
    return (
        parse_benchmark(taken)
        .withColumn("answer", final_answer(F.col("answer")))
        .withColumn("prompt", json_escape(F.col("question")))
    )
