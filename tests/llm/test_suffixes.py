"""Repeated bytes against brute force, the suffix order, and the odd inputs."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import suffixes


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in texts:
        if i is not None:
            for p in range(len(data) - length + 1):
                w = data[p:p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if i is not None and first[data[p:p + length]] < i:
                gone[p:p + length] = b"\x01" * length
        spans = sum(g and not p for p, g in zip(b"\x00" + gone, gone, strict=False))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@given(st.binary(min_size=1, max_size=300), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_order(data, letters):
    text = np.frombuffer(data, np.uint8) % letters
    starts = np.arange(len(text))
    order = suffixes.suffix_order(text, starts)
    found = [text[p:p + 50].tobytes() for p in order]
    assert sorted(order) == list(starts) and found == sorted(found)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(suffixes.repeated_bytes(df))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_repeats(spark, seed):
    """Small alphabets: anchors tie, strings overlap, repeats chain over several documents."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abé"), 400)) for _ in range(4)] + ["ab" * 200, "a" * 300]
    rows = []
    for i in range(60):
        cuts = [base[k][a:a + n] for k, a, n in zip(
            rng.integers(0, 6, 4), rng.integers(0, 250, 4), rng.integers(20, 140, 4), strict=True)]
        rows.append((int(rng.integers(0, 1000)) * 100 + i, "x".join(cuts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(suffixes.repeated_bytes(df)) == brute(rows)


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(100_000))
    rows = [(5, None), (6, ""), (7, "a" * 49), (8, "a" * 50), (9, "a" * 50), (9, "a" * 50),
            (9, "a" * 49 + "é"), (None, "a" * 60), (-3, "b" * 70), (4, "b" * 70), (10, long),
            (11, long[777:200_000])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    assert result(suffixes.repeated_bytes(df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_bytes(df).collect() == []


def test_groups_follow_the_text_and_not_the_partitions(spark, monkeypatch):
    asked = []
    real = suffixes._anchor_rows
    monkeypatch.setattr(suffixes, "_anchor_rows", lambda n: asked.append(n) or real(n))
    df = spark.createDataFrame([(1, "a" * 3000), (2, "b" * 3000)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            suffixes.repeated_bytes(df)
        monkeypatch.setattr(suffixes, "GROUP", 1000)
        suffixes.repeated_bytes(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert asked == [1, 1, 7]
