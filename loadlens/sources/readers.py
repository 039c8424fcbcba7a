"""File readers.  Each one that depends on file order adds it as column ``ord``."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import schemas
from loadlens.functions.text import strip
from loadlens.functions.columns import require_columns
from loadlens.sources.records import read_csv

log = logging.getLogger(__name__)


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``ord``, which sorts rows as they stand in their files.

    Call it directly on a file scan: file, block within the file, row within the block.
    """
    return df.withColumn("ord", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ))


# Options and extra columns with which ragged rows of a CSV file can be told apart.
RAGGED = {"header": True, "mode": "PERMISSIVE", "escape": '"',
          "columnNameOfCorruptRecord": "_corrupt"}


def ragged_layout(names: Sequence[str]) -> T.StructType:
    """Text columns ``names`` and the two columns :func:`drop_surplus` looks at."""
    return schemas.layout([*names, "_extra", "_corrupt"], lambda _: T.StringType())


def drop_surplus(rows: DataFrame) -> DataFrame:
    """Rows without surplus fields; short rows stay, padded with missing values.

    The declared layout is one field wider than the header, so every good row counts
    as incomplete, while a row that fills the extra field or overflows it has too many.
    """
    return rows.filter("_corrupt is not null and _extra is null").drop("_extra", "_corrupt")


def read_load_samples(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Load-tool samples, all columns as text, without rows that have surplus fields.

    Quoted fields may hold line breaks; a file is read by as many tasks as it has byte ranges.
    """
    return drop_surplus(read_csv(
        spark, path, ragged_layout,
        columnNameOfCorruptRecord=RAGGED["columnNameOfCorruptRecord"])).drop("ord")


def read_host_metrics(
    spark: SparkSession, path: str, strict: bool = True,
    required: Sequence[str] = ("timestamp",), wanted: Sequence[str] = (),
) -> DataFrame:
    """Host metrics with however many core and GPU columns the headers name.

    A ``required`` column that no file has is an error, or with ``strict`` off a warning; a
    ``wanted`` one is a warning.  A report on one host requires ``schemas.HOST_REQUIRED``.
    """
    df = read_csv(spark, path, lambda names: schemas.layout(names, schemas.host_column_type))
    require_columns(df, required, strict)
    require_columns(df, wanted, strict=False)
    return df


def read_emissions(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Emissions with ISO timestamps, read as local time of ``zone``; sort at output only."""
    known = {column for column, _, _ in schemas.EMISSION_METRICS}
    df = read_csv(spark, path, lambda names: schemas.layout(
        names, lambda n: T.DoubleType() if n in known else T.StringType()))
    require_columns(df, ["timestamp"])
    return df.withColumn("timestamp", F.to_utc_timestamp(F.to_timestamp("timestamp"), zone))


def read_user_bins(spark: SparkSession, paths: Sequence[str], strict: bool = False) -> DataFrame:
    """User bins of several runs; ``run_id`` is the place of the path in the list.

    Files that are missing, empty or without ``bin_start_timestamp`` are skipped with a warning,
    or raise when ``strict``.
    """
    runs = []
    for run_id, path in enumerate(paths):
        try:
            df = read_csv(spark, path, lambda names: schemas.layout(
                names, lambda n: schemas.USER_BINS.get(n, T.StringType())))
            require_columns(df, ["bin_start_timestamp"])
        except (AnalysisException, ValueError) as error:
            if strict:
                raise
            log.warning("run file %s skipped: %s", path, str(error).split("\n")[0])
            continue
        runs.append(df.withColumn("run_id", F.lit(run_id)))
    if not runs:
        raise ValueError("no run file found")
    bins = runs[0]
    for more in runs[1:]:
        bins = bins.unionByName(more, allowMissingColumns=True)
    return bins


_QA_LAYOUT = "array<struct<question: string, answer: string, _end: int, _bad: string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines as ``value`` with their file order."""
    return with_file_order(spark.read.text(path))


def _question_and_answer(lines: DataFrame) -> DataFrame:
    """``question`` and ``answer`` of JSON lines in place of ``value``.

    A line is one JSON object and nothing else.  The parser stops at the end of a value, so
    each line is parsed as the first element of an array whose second one marks the end: what
    goes on after the object breaks the array, closes it early or adds an element.
    """
    others = [c for c in lines.columns if c != "value"]
    objects = F.from_json(
        F.concat(F.lit("["), "value", F.lit(',{"_end":1}]')), _QA_LAYOUT, {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
            "allowSingleQuotes": "false", "allowUnquotedControlChars": "false"})
    closed = F.rtrim("value", F.lit(" \t\r\n")).endswith("}")
    row = F.get("_rows", F.lit(0))
    return lines.filter(closed).withColumn("_rows", objects).filter(
        (F.size("_rows") == 2) & (F.get("_rows", F.lit(1))["_end"] == 1)
        & row.isNotNull() & row["_bad"].isNull()).select(
        *others, row["question"].alias("question"), row["answer"].alias("answer"))


def parse_benchmark(lines: DataFrame) -> DataFrame:
    """Question and answer of JSON lines, trimmed.

    Blank lines, invalid JSON and rows without a question or an answer are left out.
    """
    return _question_and_answer(lines).withColumns({
        c: strip(F.col(c)) for c in ("question", "answer")
    }).filter("question <> '' and answer <> ''")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark JSONL as question and answer, in file order by ``ord``."""
    return parse_benchmark(read_lines(spark, path))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer pairs as they stand; a bad line is skipped."""
    return _question_and_answer(read_lines(spark, path)).filter("question is not null")


def keep_answered(spans: DataFrame) -> DataFrame:
    """Spans with an input and an output, both trimmed; blank text passes and becomes empty."""
    question, output = (schemas.quoted(n) for n in (schemas.SPAN_INPUT, schemas.SPAN_OUTPUT))
    return (
        spans.filter((F.col(question) != "") & (F.col(output) != ""))
        .withColumn("question", strip(F.col(question)))
        .withColumn("generated_answer", strip(F.col(output)))
    )


def read_spans(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Trace spans as text with ``question`` and ``generated_answer`` added.

    Values may hold line breaks; a file is read by as many tasks as it has byte ranges.
    """
    return keep_answered(read_csv(
        spark, path, lambda names: schemas.layout(names, lambda _: T.StringType()),
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"))


def read_chat(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chat corpus: one array of turns per conversation."""
    return spark.read.json(path, schema=schemas.CHAT, multiLine=multi_line)
