import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.functions import text
from loadlens.operators import evaluate, qa
from loadlens.sources import readers, writers

LINES = [
    '{"question":" q1 ","answer":"x #### 1 #### 18 "}', "", "{bad",
    '{"question":"q2","answer":null}', '{"question":"say \\"hi\\"\\nnow","answer":"7"}',
    '{"question":"q3","answer":"é"}', '{"question":"q4","answer":"1"}',
]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bench") / "bench.jsonl"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return readers.read_lines(spark, str(path))


def test_extraction(spark, lines):
    got = qa.extract_qa(lines, 6).orderBy("ord").collect()
    assert [(r.question, r.answer, r.prompt) for r in got] == [
        ("q1", "18", "q1"), ('say "hi"\nnow', "7", 'say \\"hi\\" now'), ("q3", "é", "q3")]
    assert qa.extract_qa(lines).count() == 4
    assert qa.extract_qa(lines, 2).count() == 1


def test_file_order_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f"line {i:05d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        many = readers.read_lines(spark, str(path))
        assert many.rdd.getNumPartitions() > 4
        got = [r.value for r in qa.head_lines(many, 1500).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"line {i:05d}" for i in range(1500)]


def test_written_files(spark, lines, tmp_path):
    pairs = qa.extract_qa(lines, 6)
    writers.write_prompts(pairs, str(tmp_path / "prompts"))
    written = [ln for p in sorted((tmp_path / "prompts").glob("part-*"))
               for ln in p.read_text(encoding="utf-8").splitlines()]
    assert [ln for ln in written if ln != "prompt"] == ["q1", r'say \\\"hi\\\" now', "q3"]
    assert written[0] == "prompt"
    writers.write_qa(pairs, str(tmp_path / "qa"))
    rows = [json.loads(ln) for p in sorted((tmp_path / "qa").glob("part-*"))
            for ln in p.read_text(encoding="utf-8").splitlines()]
    assert rows == [{"question": "q1", "answer": "18"}, {"question": 'say "hi"\nnow', "answer": "7"},
                    {"question": "q3", "answer": "é"}]
    assert any("é" in p.read_text(encoding="utf-8") for p in (tmp_path / "qa").glob("part-*"))
    back = readers.read_qa(spark, str(tmp_path / "qa"))
    assert back.count() == 3


@pytest.mark.parametrize("raw, want", [
    ("18", ("i", None, "18")), ("18.0", ("f", 18.0, None)), ("18.50", ("f", 18.5, None)),
    ("007", ("i", None, "7")), ("000", ("i", None, "0")), ("$1,234", ("i", None, "1234")),
    ("-5", ("i", None, "5")), ("5.", ("f", 5.0, None)), (".5", ("f", 0.5, None)),
    ("1.2.3", ("s", None, "1.2.3")), (".", ("s", None, ".")), ("abc ", ("s", None, "abc")),
    ("NONE", ("s", None, "NONE")), ("ERROR", ("s", None, "ERROR")), ("", ("s", None, "")),
    ("٣", ("i", None, "3")), ("9" * 30, ("i", None, "9" * 30)), ("9" * 4301, ("i", None, "9" * 4301)),
])
def test_answer_key(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert tuple(df.select(text.answer_key(F.col("a")).alias("k")).head().k) == want


@pytest.mark.parametrize("reply, want", [
    ("1,234", "1"), ("-5", "5"), ("12abc", "12abc"), ("none", "NONE"), (" None\n", "NONE"),
    ("The answer is 3.50.", "3.50"), ("\t7 ", "7"), ("", ""), ("no number", "no number"),
    ("é5 6", "6"),
])
def test_parse_reply(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "a string")
    assert df.select(text.parse_reply(F.col("a")).alias("r")).head().r == want


@pytest.mark.parametrize("body, want", [
    ('{"response":" 18 "}', "18"), ('{"response":"","choices":[{"text":"5"}]}', "5"),
    ('{"choices":[{"text":"5"}]}', "5"), ("{}", ""), ("not json", "ERROR"), ('{"choices":[]}', "ERROR"),
])
def test_reply_text(spark, body, want):
    df = spark.createDataFrame([(body,)], "a string")
    assert df.select(text.reply_text(F.col("a")).alias("r")).head().r == want


def test_strip_is_python_strip(spark):
    raw = [" a b ", "\x1c x　\n", "​keep", "", "\r\n"]
    df = spark.createDataFrame([(r,) for r in raw], "a string")
    assert [r.s for r in df.select(text.strip(F.col("a")).alias("s")).collect()] == [
        r.strip() for r in raw]


QA = [("q1", "18"), ("q1", "20"), ("q2", "18"), ("q3", "-5"), ("q4", "1,234"), ("q5", "NONE"), ("q6", "1")]
SPANS = [
    ("q1", "20"), ("q1", "20"), ("q2", "18.0"), ("q3", "-5"), ("q9", "3"), ("q4", "1,234"),
    ("q5", "none"), ("q6", ""), (" q2 ", "18"),
]
LABELS = {0: "true", 1: "DUPLICATE", 2: "false", 3: "true", 4: "NO_GROUND_TRUTH", 5: "false",
          6: "true", 8: "DUPLICATE"}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("eval")
    frame = pd.DataFrame([
        dict.fromkeys(schemas.SPAN_COLUMNS, "x") | {
            "extra": f"line one\nrow {i}, \"quoted\"", "context.span_id": str(i),
            schemas.SPAN_INPUT: q, schemas.SPAN_OUTPUT: a}
        for i, (q, a) in enumerate(SPANS)])
    frame.to_csv(folder / "spans.csv", index=False)
    (folder / "qa.jsonl").write_text(
        "".join(json.dumps({"question": q, "answer": a}) + "\n" for q, a in QA) + "{bad\n")
    truth = evaluate.ground_truth(readers.read_qa(spark, str(folder / "qa.jsonl")))
    assert {r.question: r.ground_truth for r in truth.collect()}["q1"] == "20"
    spans = readers.read_spans(spark, str(folder / "spans.csv"))
    # The reply stands for what a judge model said.
    return evaluate.evaluate(spans, truth, extractor=lambda answer: answer).cache()


def test_labels(results):
    got = {int(r["context.span_id"]): r.correctness for r in results.collect()}
    assert got == LABELS


def test_summary(results):
    assert evaluate.evaluation_summary(results).head().asDict() == {
        "total_questions_processed": 6, "total_rows_in_csv": 7, "duplicate_questions_skipped": 2,
        "correct_answers": 3, "incorrect_answers": 3, "accuracy_percentage": 60.0}
    report = evaluate.evaluation_report(results).head()
    assert (report.all_rows, report.questions_with_truth, report.incorrect) == (8, 5, 2)
    empty = evaluate.evaluation_summary(results.limit(0)).head()
    assert empty.accuracy_percentage == 0.0 and empty.total_questions_processed == 0


def test_results_file(spark, results, tmp_path):
    writers.write_results(results, str(tmp_path / "out"))
    parts = [pd.read_csv(p, dtype=str) for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    frame = pd.concat(parts)
    assert list(frame.columns) == [*schemas.SPAN_COLUMNS, "extra", "correctness"]
    assert frame["context.span_id"].tolist() == [str(i) for i in LABELS]
    assert frame["extra"].iloc[0] == 'line one\nrow 0, "quoted"'
    writers.write_summary(evaluate.evaluation_summary(results), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).head().accuracy_percentage == 60.0
    for limit, kept in ((3, ["0", "1", "2"]), (None, [str(i) for i in LABELS])):
        writers.export_spans(results, str(tmp_path / "export"), limit)
        back = spark.read.csv(str(tmp_path / "export"), header=True, multiLine=True, escape='"')
        assert sorted(r["context.span_id"] for r in back.collect()) == sorted(kept)


def test_one_first_row_per_question(results):
    per_question = results.groupBy("question").agg(
        F.count_if(F.col("correctness") != "DUPLICATE").alias("n")).collect()
    assert {r.n for r in per_question} == {1}


def test_blank_question_passes(spark):
    df = spark.createDataFrame([("  ", "a"), ("", "a"), ("q", None)],
                               f"`{schemas.SPAN_INPUT}` string, `{schemas.SPAN_OUTPUT}` string")
    got = readers.keep_answered(df).collect()
    assert [(r.question, r.generated_answer) for r in got] == [("", "a")]


def test_extractor_sees_only_needed_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def judge(answers: pd.Series) -> pd.Series:
        seen.add(len(answers))
        return answers

    spans = spark.createDataFrame(
        [(i, f"q{i % 4}", "1") for i in range(40)], "ord int, question string, generated_answer string")
    truth = spark.createDataFrame([("q1", "1"), ("q2", "2")], "question string, ground_truth string")
    got = evaluate.evaluate(spans, truth, judge).groupBy("correctness").count().collect()
    assert {r.correctness: r["count"] for r in got} == {
        "true": 1, "false": 1, "NO_GROUND_TRUTH": 2, "DUPLICATE": 36}
    assert seen.value == 2


def test_repeated_ids_and_equal_rows(spark):
    """As many rows out as in, one of them first for each question."""
    rows = [(1, 7, "a", "1"), (1, 7, "a", "1"), (1, 7, "a", "2"), (1, 7, "b", "1"),
            (2, 7, "b", "1"), (None, 1, "c", "1"), (3, 9, "c", "1"), (3, 8, "c", "1"),
            (None, None, "d", "1")]
    spans = spark.createDataFrame(
        rows, "start int, id int, question string, generated_answer string").repartition(4)
    marked = evaluate.mark_duplicates(spans, ["start", "id"]).collect()
    assert sorted(str(tuple(r)[:4]) for r in marked) == sorted(map(str, rows))
    firsts = [r for r in marked if not r.is_duplicate]
    assert sorted((r.question, r.start, r.id) for r in firsts) == [
        ("a", 1, 7), ("b", 1, 7), ("c", 3, 8), ("d", None, None)]
    truth = spark.createDataFrame([("b", "1"), ("c", "5")], "question string, ground_truth string")
    got = evaluate.evaluate(spans, truth, order_by=["start", "id"])
    assert {r.correctness: r["count"] for r in got.groupBy("correctness").count().collect()} == {
        "true": 1, "false": 1, "NO_GROUND_TRUTH": 2, "DUPLICATE": 5}


def test_first_rows_use_hash_aggregates(spark):
    spans = spark.range(100).selectExpr("id % 9 AS question", "id AS ord")
    plan = evaluate.first_rows(*evaluate._with_order(spans, ["ord"]))._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_failed_extractor(spark):
    df = spark.createDataFrame([("7",)], "generated_answer string")
    failing = evaluate.extract_answer(df, lambda c: F.lit(None).cast("string"))
    assert failing.head().extracted_answer == "ERROR"
    default = spark.createDataFrame(
        [("costs 1,234 or 2.5.",), ("none here",)], "generated_answer string")
    assert [r.extracted_answer for r in evaluate.extract_answer(default).collect()] == ["2.5", "NONE"]


@pytest.mark.parametrize("line, kept", [
    ('{"question":"a","answer":"b"}', True),
    ('{"question":"a","answer":"b"', False),
    ('{"question":"a","answer":', False),
    ('{"question":"a"}', False),
    ('{"answer":"b","question":"a","more":[1,{"x":2}]}', True),
    ('  {"question":"a","answer":"b"}  ', True),
    ("[]", False), ("5", False), ('"text"', False),
    ('{"question":"a","answer":"b"} trailing', False),
])
def test_json_lines(spark, line, kept):
    df = spark.createDataFrame([(0, line)], "ord int, value string")
    assert (readers.parse_benchmark(df).count() == 1) is kept
