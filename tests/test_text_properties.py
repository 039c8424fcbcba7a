"""Text expressions: worked cases, and what holds for many random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loadlens.functions import text

PIECES = [
    "####", "##", "#", " ", "\t", "\n", "\r", "\\", '"', "|", "é", "漢", "18", "007", "0", ".", ",",
    "$", "-", "NONE", "none", "ERROR", "\x1c", " ", "　", "​", "٣", "x1", "1.50", "😀",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = {"".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(4000)}
    return sorted(made)


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()


def column(frame, expr):
    return [r.v for r in frame.select("i", expr.alias("v")).orderBy("i").collect()]


def test_strip(frame, texts):
    assert column(frame, text.strip(F.col("t"))) == [t.strip() for t in texts]


def test_final_answer(frame, texts, spark):
    """Text put before a marker never shows, and text without one is only trimmed."""
    got = column(frame, text.final_answer(F.col("t")))
    assert all(g == t.strip() for t, g in zip(texts, got) if "####" not in t)
    df = spark.createDataFrame(
        [(i, f"x #### y\n####{t}") for i, t in enumerate(texts) if t[:1] != "#"], "i int, t string")
    assert column(df, text.final_answer(F.col("t"))) == [
        g for t, g in zip(texts, got) if t[:1] != "#"]


def test_escaped_prompt_reads_back(frame, texts):
    """The escaped text inside quotes is JSON for the text with its line breaks blanked."""
    import json

    got = column(frame, text.json_escape(F.col("t")))
    for raw, safe in zip(texts, got):
        if not re.search(r'["\\\r\n]', raw):
            assert safe == raw
        elif not re.search("[\t\x1c]", safe):
            # Trailing blanks are trimmed after escaping, so compare trimmed.
            assert json.loads(f'"{safe}"') == re.sub("[\r\n]", " ", raw).strip()


def test_pipe_escape_reads_back(frame, texts):
    got = column(frame, text.pipe_escape(F.col("t")))
    assert [re.sub(r"\\(.)", r"\1", g) for g in got] == texts
    assert not any(re.search(r'(?<!\\)(?:\\\\)*[|"]', g) for g in got)


def keys(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "i int, t string")
    return [tuple(k) for k in column(df, text.answer_key(F.col("t")))]


@pytest.mark.parametrize("answer, key", [
    ("18", ("i", None, "18")), ("18.0", ("f", 18.0, None)), ("18.50", ("f", 18.5, None)),
    ("007", ("i", None, "7")), ("$1,234", ("i", None, "1234")), ("-5", ("i", None, "5")),
    ("5.", ("f", 5.0, None)), (".5", ("f", 0.5, None)), ("1.2.3", ("s", None, "1.2.3")),
    (".", ("s", None, ".")), ("abc ", ("s", None, "abc")), ("NONE", ("s", None, "NONE")),
    ("ERROR", ("s", None, "ERROR")), ("", ("s", None, "")), ("٣", ("i", None, "3")),
    ("\U0001d7d7\U0001e951", ("i", None, "91")), ("000", ("i", None, "0")),
])
def test_answer_key(spark, answer, key):
    assert keys(spark, [answer]) == [key]


def test_integers_of_any_length(spark):
    """Zeros in front, separators and signs never change an integer's key."""
    rng = random.Random(3)
    numbers = ["9" * 5000, *(str(rng.randrange(1, 10 ** rng.randint(1, 30))) for _ in range(300))]
    plain = keys(spark, numbers)
    assert {k[0] for k in plain} == {"i"} and len(set(plain)) == len(set(numbers))
    for change in (lambda n: f"000{n}", lambda n: f"-{n}", lambda n: f"${n[:1]},{n[1:]}",
                   lambda n: f"  {n} kg"):
        assert keys(spark, map(change, numbers)) == plain


def test_a_decimal_point_changes_the_kind(spark):
    numbers = [str(n) for n in range(0, 3000, 7)]
    decimals = keys(spark, [f"{n}.0" for n in numbers])
    assert {k[0] for k in decimals} == {"f"}
    assert [k[1] for k in decimals] == [float(n) for n in numbers]


def test_trimming_never_changes_the_key(frame, texts, spark):
    same = [t for t in texts if t.strip() == t and t]
    assert keys(spark, [f"\t {t}\n" for t in same if t not in ("NONE", "ERROR")]) == keys(
        spark, [t for t in same if t not in ("NONE", "ERROR")])


@pytest.mark.parametrize("reply, parsed", [
    ("18", "18"), (" 18.50 kg", "18.50"), ("none ", "NONE"), ("None", "NONE"),
    ("none of 3", "3"), ("-5", "5"), ("1,234", "1"), ("x1 2", "2"), ("it is 7.", "7"),
    ("1.2.3", "1.2"), (" no number ", "no number"), ("", ""), ("\x1cERROR", "ERROR"),
])
def test_parse_reply(spark, reply, parsed):
    df = spark.createDataFrame([(reply,)], "t string")
    assert df.select(text.parse_reply(F.col("t"))).first()[0] == parsed


def test_parsed_replies_stay(frame, texts, spark):
    """A parsed reply parses to itself."""
    once = column(frame, text.parse_reply(F.col("t")))
    df = spark.createDataFrame(list(enumerate(once)), "i int, t string")
    assert column(df, text.parse_reply(F.col("t"))) == once
