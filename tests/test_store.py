"""Written tables go when their scratch or session does."""

import os

from loadlens.operators import evaluate, telemetry
from loadlens.session import shared_dir
from loadlens.sources import store


def folders(spark):
    path = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(path) if f.startswith("loadlens-")}


def test_scratch_leaves_nothing(spark):
    before = folders(spark)
    with store.scratch(spark):
        kept = store.stored(spark.range(5))
        rows = spark.range(40).selectExpr(
            "id AS ord", "id % 7 AS question", "double(id) AS x", "'1' AS generated_answer")
        averaged = telemetry.moving_average(rows, ["x"], ["ord"])
        assert averaged.count() == 40 and evaluate.mark_duplicates(rows).count() == 40
        assert telemetry.sample_ticks(rows, ["ord"]).count() == 8
        assert kept.count() == 5 and folders(spark) > before
    assert folders(spark) == before


def test_scratch_in_scratch(spark):
    with store.scratch(spark):
        outer = store.stored(spark.range(3))
        with store.scratch(spark):
            assert store.stored(spark.range(4)).count() == 4
        assert outer.count() == 3


def test_release(spark):
    store.stored(spark.range(2))
    assert folders(spark)
    made = {p.rsplit("/", 1)[1] for p in store._FOLDERS[spark.sparkContext.applicationId]}
    store.release(spark)
    assert not folders(spark) & made
