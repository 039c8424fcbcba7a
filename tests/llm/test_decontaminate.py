"""Decontamination against brute force over all windows, and the odd inputs."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loadlens.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    """Best similarity of any item-sized window for each document and item at 80 %."""
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            k = min(5, len(q))
            if not q or i is None or len(w) < k:
                continue
            want, n = bag(q, k), min(len(q), len(w))
            for s in range(len(w) - n + 1):
                have = bag(w[s:s + n], k)
                both = sum((have & want).values())
                union = sum(have.values()) + sum(want.values()) - both
                if 100 * both >= 80 * union:
                    found[d, i] = max(found.get((d, i), 0), both / union)
    return found


def result(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def test_planted(spark):
    rng = np.random.default_rng(5)

    def prose(n):
        return [f"w{int(x)}" for x in rng.integers(0, 400, n)]

    items = [(i, " ".join(prose(int(n)))) for i, n in enumerate(rng.integers(3, 40, 25))]
    docs = []
    for d in range(120):
        text = prose(int(rng.integers(0, 60)))
        if d % 2:
            item = items[int(rng.integers(0, 25))][1].split()
            if d % 8 == 7:
                item[int(rng.integers(0, len(item)))] = "changed"
            if d % 15 == 0:
                item.insert(len(item) // 2, "more")
            text = text + item + prose(int(rng.integers(0, 30)))
        docs.append((d, ", ".join(text).upper() if d % 3 else " ".join(text)))
    got = result(decontaminate.matches(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("n_chars < 3000").collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    got = result(decontaminate.matches(docs.filter("n_chars < 3000"), items))
    assert got == brute(rows, asked)


def test_radius_covers_the_similarity(spark):
    """Fingerprints of texts at the threshold stay within the radius."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        own = [int(x) for x in rng.integers(0, 2**62, 40)]
        other = own[:36] + [int(x) for x in rng.integers(0, 2**62, 4)]
        rows += [(i, 0, h) for h in own] + [(i, 1, h) for h in other]
    prints = decontaminate._fingerprints(
        spark.createDataFrame(rows, "i int, side int, h long"), "i", "side")
    pairs = prints.groupBy("i").agg(F.collect_list("print").alias("p")).select(
        F.bit_count(F.col("p")[0].bitwiseXOR(F.col("p")[1])).alias("d")).collect()
    assert max(r.d for r in pairs) <= decontaminate.RADIUS


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None, 0), (2, "", 0), (3, "...", 0), (4, item, 0), (4, item, 1), (None, item, 0),
            (5, item.replace(" ", "-").upper(), 0), (6, "x " * 50_000 + item, 0),
            (7, "one two three four five six seven eight nine", 0), (8, "alone", 0)]
    items = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "Alone!"), (5, "x x x x x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(4, 1), (None, 1), (5, 1), (6, 1), (7, 1), (8, 4), (6, 5)}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.matches(df.limit(0), bench).collect() == []
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)
