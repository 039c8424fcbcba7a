"""Language identification and the quality classifier: held-out accuracy, parts, odd inputs."""

import itertools
import zlib

import numpy as np
import pytest

from loadlens.llm import language, nbsvm
from loadlens.llm.queries import op4_quality, op8_language

SF_DIR = "/root/testdata/sf0.01"


def held(doc_id, by, rest):
    return zlib.crc32(str(doc_id).encode()) % by == rest


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op8_language(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    mine = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(mine) > 0.98


def test_quality_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = op4_quality(spark, SF_DIR).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.3) for r in rows)
    mine = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in mine]) > 0.9
    assert all(b == 1 for a, b in mine if a == 1)


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog are in the house", "en"), ("le chat et le chien dans la maison", "fr"),
            ("это кошка и это собака в доме", "ru"), ("это большая рыба", "ru"),
            ("the house of the dog", "en"), ("la maison du chien", "fr"), (None, "xx"), ("x", None)]
    return language.train(spark.createDataFrame(rows * 5, "text string, lang string"))


def spans(spark, model, text):
    df = spark.createDataFrame([(1, text, 9.5)], "doc_id long, text string, score double")
    [row] = language.label(df, model).collect()
    assert row.doc_id == 1 and row.text == text
    return row.lang_pred, [(s.start, s.words, s.lang) for s in row.spans]


def test_mixed_text(spark, model):
    assert model.languages == ["en", "fr", "ru"]
    text = "the dog and the house, " * 3 + "la maison et le chien! " * 2 + "кошка the собака рыба"
    pred, found = spans(spark, model, text)
    assert pred == "en"
    assert [lang for _, _, lang in found][:2] == ["en", "fr"] and found[0][:2] == (0, 15)
    assert found[-1][2] == "ru" and sum(n for _, n, _ in found) == 29


def test_script_narrows(spark, model):
    """A word of unseen letters goes to the language of its script."""
    assert spans(spark, model, "жщ")[0] == "ru"


def test_odd_texts(spark, model):
    for text in (None, "", "12 34 !!", " \n\t"):
        assert spans(spark, model, text) == ("und", [])
    assert spans(spark, model, "the " * 100_000) == ("en", [(0, 100_000, "en")])
    assert spans(spark, model, "漢字")[0] in model.languages


def test_marks_belong_to_words(spark, model):
    assert language._split("हिन्दी में क\u0301") == ["हिन्दी", "में", "क\u0301"]
    assert language._split("cafe\u0301 \u0301 a1b_c") == ["cafe\u0301", "a", "b", "c"]
    assert language._split("İz".lower()) == ["i\u0307z"]
    assert spans(spark, model, "\u0301 \u093f") == ("und", [])
    [(first, words, _)] = spans(spark, model, "e" + "\u0301" * 100_000)[1]
    assert (first, words) == (0, 1)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    [row] = language.identify(df).collect()
    assert (row.lang_pred, row.score, row.spans) == ("und", 0.0, [])
    assert language.identify(df.limit(0)).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(20, 3)).astype(np.float32) * 3
    ids = rng.integers(0, 20, 30).astype(np.int32)
    offsets = np.array([0, 0, 6, 13, 14, 21, 30])
    path = language._viterbi(ids, offsets, scores, 2.0)

    def total(own, states):
        return sum(scores[i, s] for i, s in zip(own, states, strict=True)) - 2.0 * sum(
            a != b for a, b in itertools.pairwise(states))

    for a, b in itertools.pairwise(offsets):
        own = ids[a:b]
        best = max((total(own, s) for s in itertools.product(range(3), repeat=min(len(own), 7))
                    if len(s) == len(own)), default=None)
        if best is not None:
            assert abs(total(own, path[a:b]) - best) < 1e-4


def test_quality_odd_rows(spark):
    good, bad = "plain words in a row.", "a%% b&& c## d$$"
    docs = spark.createDataFrame(
        [(i, good if i % 3 else bad, 0.5) for i in range(60)]
        + [(100, None, 0.1), (101, "", 0.1), (None, good, 0.1), (7, good, 0.1), (200, "w " * 200_000, 0.1)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(50)] + [(50, None), (None, 1), (3, 0), (51, 7)],
        "doc_id long, quality int")
    rows = nbsvm.quality(docs, labels).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id is not None and r.doc_id < 60)
    empty = {r.doc_id: r.score for r in rows if r.doc_id in (100, 101)}
    assert empty[100] == empty[101]
    assert not next(r for r in rows if r.doc_id is None).held_out


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_quality_of_one_class(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    rows = nbsvm.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    share = (sum(q for _, q in labels) + 1) / (len(labels) + 2)
    assert [round(r.score, 9) for r in rows] == [round(share, 9)] * 2
    assert nbsvm.quality(docs.limit(0), spark.createDataFrame(
        labels, "doc_id long, quality int")).collect() == []


def test_quality_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr(
        "if(id < 2000, 7, id) key", "concat('text ', id % 1500, ' of ', id) text").unionByName(
        spark.createDataFrame([(7, "copy")] * 50 + [(7, None)] * 2, "key long, text string"))
    labels = spark.range(3000).selectExpr("id key", "cast(id % 2 as int) y").unionByName(
        spark.createDataFrame([(7, 0), (7, 1), (7, 1)], "key long, y int"))
    every = nbsvm.labelled_rows(docs, labels, 10_000)
    assert every.count() == every.distinct().count() == 2 * 2002 + 1000
    few = nbsvm.labelled_rows(docs.repartition(7), labels, 100).collect()
    assert len(few) <= 100
    assert sorted(few) == sorted(nbsvm.labelled_rows(docs, labels, 100).collect())
    bags = every.mapInArrow(nbsvm._bags, "h long, y int, t long, ids array<int>")
    kept = nbsvm._bounded(bags, 5000).selectExpr("sum(size(ids))").first()[0]
    assert 4900 < kept <= 5000
