import json
import math
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens.operators import corpus
from loadlens.sources.readers import read_chat


def test_roles_and_reader(spark, tmp_path):
    path = tmp_path / "chat.json"
    path.write_text(json.dumps([
        {"id": 1, "conversations": [{"from": f, "value": v} for f, v in
                                    [("human", "a"), ("gpt", "b"), ("system", "c")]]}]))
    got = corpus.to_chat_messages(read_chat(spark, str(path)))
    assert got.columns == ["messages"]
    assert [tuple(m) for m in got.head().messages] == [
        ("user", "a"), ("assistant", "b"), ("assistant", "c")]
    prompt = corpus.render_chat(got).head().prompt
    assert prompt == "<|user|>\na\n<|assistant|>\nb\n<|assistant|>\nc"


def test_long_conversation_is_whole(spark):
    turns = spark.range(2500).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("human").alias("from"),
        F.col("id").cast("string").alias("value"))
    [row] = corpus.collect_conversations(turns.repartition(5)).collect()
    assert [m.value for m in row.conversations] == [str(i) for i in range(2500)]


@pytest.mark.parametrize("side, ids, want, mask", [
    ("right", [1, 2], [1, 2, 0, 0], [1, 1, 0, 0]),
    ("right", [1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 1, 1, 1]),
    ("left", [1, 2], [0, 0, 1, 2], [0, 0, 1, 1]),
    ("right", [], [0, 0, 0, 0], [0, 0, 0, 0]),
])
def test_padding_and_labels(spark, side, ids, want, mask):
    df = spark.createDataFrame([(ids,)], "input_ids array<int>")
    padded = corpus.pad_truncate(df, 4, side=side)
    row = corpus.with_labels(padded).head()
    assert (row.input_ids, row.attention_mask, row.labels) == (want, mask, want)
    masked = corpus.with_labels(padded, mask_pads=True).head().labels
    assert masked == [i if m else -100 for i, m in zip(want, mask)]


@pytest.mark.parametrize("rows, ratio", [(1, 0.1), (10, 0.1), (997, 0.1), (997, 0.37), (50, 1.0)])
def test_exact_split(spark, rows, ratio):
    df = spark.range(rows)
    got = corpus.split_train_test(df.repartition(7), "id", ratio, exact=True).toPandas()
    assert sorted(got["id"]) == list(range(rows))
    assert (got["split"] == "test").sum() == math.ceil(rows * ratio)
    again = corpus.split_train_test(df.repartition(3), "id", ratio, exact=True).toPandas()
    assert got.set_index("id")["split"].to_dict() == again.set_index("id")["split"].to_dict()


def test_hash_split_takes_all(spark):
    got = corpus.split_train_test(spark.range(2000), "id", 1.0)
    assert {r.split for r in got.collect()} == {"test"}
    none = corpus.split_train_test(spark.range(20), "id", 0.0, exact=True)
    assert {r.split for r in none.collect()} == {"train"}
    empty = corpus.split_train_test(spark.range(0), "id", exact=True)
    assert empty.columns == ["id", "split"] and empty.count() == 0


def test_hash_split_is_stable_partition(spark):
    df = spark.range(5000)
    one = corpus.split_train_test(df.repartition(7), "id").toPandas().set_index("id")["split"]
    two = corpus.split_train_test(df.repartition(2), "id").toPandas().set_index("id")["split"]
    assert one.to_dict() == two.to_dict() and len(one) == 5000
    assert 400 < (one == "test").sum() < 600
    other = corpus.split_train_test(df, "id", seed=7).toPandas().set_index("id")["split"]
    assert other.to_dict() != one.to_dict()


def test_tokenizers(spark):
    df = spark.createDataFrame([(" a  b\na ",)], "prompt string")
    ids = corpus.tokenise(df).head().input_ids
    assert len(ids) == 3 and ids[0] == ids[2] != ids[1]

    @F.pandas_udf("array<int>")
    def checksums(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [zlib.crc32(w.encode()) % 100 for w in s.split()])

    assert corpus.tokenise(df, checksums).head().input_ids == [
        zlib.crc32(w) % 100 for w in (b"a", b"b", b"a")]
