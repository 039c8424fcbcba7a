"""Line templates and source mixing: odd inputs; their SQL runs with the registered queries."""

import math

import pytest
from pyspark.sql import functions as F

from loadlens.llm import line_templates, mixing


def test_fields_are_generalised(spark):
    rows = [(i, f"own text number {chr(97 + i)} is here\nUser {i} logged in from host{i} at noon\n"
                f"Please accept our cookies {'abcdefghijklmnop'[i]}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, _ = line_templates.templates(df, min_docs=10)
    assert {r.template: (r.fixed, r.docs) for r in found.collect()} == {
        "User <*> logged in from <*> at noon": (6, 12),
        "Please accept our cookies <*>": (4, 12),
        "own text number <*> is here": (5, 12)}
    few, _ = line_templates.templates(df, min_docs=13)
    assert few.count() == 0


def test_prose_with_a_common_start_stays(spark):
    rows = [(i, f"it was the w{chr(97 + i)} x{chr(97 + i)} y{chr(97 + i)} z{chr(97 + i)} u{chr(97 + i)} of")
            for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_templates.drop_recurring_lines(df).filter("n_dropped > 0").count() == 0


def test_copies_are_left(spark):
    """Equal texts count once; a text that is mostly recurring lines may be left whole."""
    line = "the very same line in all of them"
    rows = [(i, line) for i in range(30)] + [(100 + i, f"{line}\nown {chr(97 + i)} " + "text " * 20)
                                             for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    assert got[0].text == "" and got[0].n_dropped == 1 and not got[104].text.startswith("the very")
    spared = {r.doc_id: r for r in line_templates.drop_recurring_lines(df, copies=0.5).collect()}
    assert spared[0].text == line and spared[0].n_dropped == 0 and spared[104].n_dropped == 1


def test_odd_rows(spark):
    line = "a line that ten documents have"
    rows = [(i, f"{line}\n{chr(97 + i)}", 5) for i in range(10)]
    rows += [(None, f"x\n\n {line} \n", 5), (50, None, 5), (51, "", 5), (52, "\n\n", 5),
             (3, f"{line}\n{line}\nz", 5), (53, f"{line}\n" + "long " * 200_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = line_templates.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "n_chars_dropped"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text if r.doc_id != 53 else None, r.n_lines, r.n_dropped))
    assert sorted(got[3]) == [("d", 2, 1), ("z", 3, 2)]
    assert got[None] == [("x\n\n", 4, 1)]
    assert got[50] == [(None, 0, 0)] and got[51] == [("", 1, 0)] and got[52] == [("\n\n", 3, 0)]
    assert got[53] == [(None, 2, 1)]
    assert line_templates.drop_recurring_lines(df.limit(0)).collect() == []


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")


def test_targets(spark):
    rows = [(1, "a", 10, 1.0), (2, "b", 1000, 1.0), (3, "c", 20, 1.0), (4, None, 500, 1.0), (5, "d", 0, 1.0)]
    got = {r.source: (r.source_size, r.target) for r in
           mixing.source_targets(sizes(spark, rows)).collect()}
    # In order a b c d null weigh 1 2 3 1 2; a and c and d are capped, b and null share the rest.
    rest = 1530 - 30 - 60
    assert got == {"a": (10, 30.0), "c": (20, 60.0), "d": (0, 0.0), "b": (1000, rest / 2),
                   None: (500, rest / 2)}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_mix(spark, buckets):
    rows = [(i, "abc"[i % 3] if i % 7 else None, i % 50, [None, 0.0, 0.5, 2.0][i % 4])
            for i in range(1000)]
    df = sizes(spark, rows)
    out = mixing.mix(df, buckets=buckets).collect()
    again = mixing.mix(df.repartition(5), buckets=4096).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    taken = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), own in taken.items():
        assert sum(own) == math.floor(target)


def test_quality_raises_the_chance(spark):
    rows = [(i, "a", 10, 4.0 if i % 2 else 0.25) for i in range(2000)]
    rows += [(5000 + i, "b", 10, 1.0) for i in range(200)] + [(9000, "c", 30000, 1.0)]
    out = mixing.mix(sizes(spark, rows)).filter("doc_id < 5000")
    got = out.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).collect()
    taken = {r.odd: r.t for r in got}
    base = out.first()
    assert taken[1] > taken[0] or base.target >= base.source_size


def test_mix_odd_rows(spark):
    rows = [(None, None, 0, None), (1, "a", 0, -1.0), (1, "a", 5, 1.0), (1, "a", 5, 1.0)]
    out = mixing.mix(sizes(spark, rows)).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 10
    assert mixing.mix(sizes(spark, rows).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(sizes(spark, rows[:1])).collect()] == [0]
    docs = spark.createDataFrame(
        [(1, "s", None), (2, "s", ""), (3, "s", " a\tb\x0bc\xa0d "), (3, "s", "x")],
        "doc_id long, source string, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = sorted((r.doc_id, r["size"], r.quality) for r in mixing.sized(docs, labels).collect())
    assert got == [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.25), (3, 3, 1.25)]
