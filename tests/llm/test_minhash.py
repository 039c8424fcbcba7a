"""MinHash near-duplicates against brute force, and the odd inputs."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loadlens.llm import graph, minhash
from loadlens.llm.queries import op1_minhash
from loadlens.sources import store

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_is_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op1_minhash(spark, sf_dir)) == brute(rows, 2)


def test_chain_in_one_bucket(spark):
    """Neighbours agree, ends do not: leaders alone would leave the chain in pieces."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - i, " ".join(words[i * 3:i * 3 + 100])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(minhash.near_duplicates(df, 2))
    assert got == brute(rows, 2)
    assert {c for _, c, _ in got.values()} == {71}


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\r\n", "x"), (4, "One", "x"), (5, "oNE ", "x"),
        (6, "one two", "x"), (7, "ÉTÉ one", "x"), (8, "été one", "x"), (9, "a b c", None),
        (9, "a b c", None), (10, "a\x0bb\x0cc", "x"), (None, "a b c", "x"),
        (11, "x " * 200_000, "x"), (12, "x x", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(minhash.near_duplicates(df, 2).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in got] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 2, 9, True), (9, 2, 9, True),
        (10, 2, 9, False), (11, 1, 11, True), (12, 1, 11, False), (None, 2, None, True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []


def test_texts_of_one_doc_id(spark):
    """Each text of a repeated doc_id is linked by its own words."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "x y")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, 2).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_one_row_of_each_class(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, a, "x"), (None, a, "x"), (5, a + " more", "x"),
            (None, "only one", "x"), (None, "only one", "x"), (6, None, "x"), (6, None, "x"), (7, "", "x"),
            (8, "same row", "y"), (8, "same row", "y"), (8, "same row", "z")]
    names = "doc_id long, text string, root string"
    df = spark.createDataFrame(rows, names).withColumns(
        {c: F.lit(7) for c in ("own", "name", "row", "best", "_gone", "set_hash", "text_hash")})
    got = minhash.representatives(df.repartition(3), 2)
    assert got.columns == df.columns
    kept = sorted((tuple(r)[:2] for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (None, "only one"), (6, None), (6, None), (7, ""),
                           (8, "same row")], key=str)
    assert minhash.representatives(df.limit(0)).collect() == []


def test_links_of_a_group_stay_few(spark, monkeypatch):
    """Near copies whose buckets begin with a text outside their class."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join([*base[:42], *(f"y{i}z{j}" for j in range(12))])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = minhash._verified

    def counted(pairs, sets, percent):
        found = real(pairs, sets, percent)
        seen.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_verified", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {d: 0 if d < 60 else d for d, _ in rows}
    # All pairs of the group would be 1,770.
    assert sum(seen) < 700


def test_components_of_more_links_than_one_task_takes(spark, monkeypatch):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    monkeypatch.setattr(graph, "LINKS", 4)
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).collect() == []


def test_tables_between_steps_go(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words")],
                               "doc_id long, text string")
    made = store._FOLDERS.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    assert sorted(r.doc_id for r in minhash.representatives(df, 2).collect()) == [1, 3]
    assert len(made) == before + 1


def test_large_group_of_strays(spark, monkeypatch):
    """Copies with too many changes of their own are told from the group without a comparison."""
    base = [f"w{i}" for i in range(120)]

    def changed(i, places):
        return " ".join(f"x{i}_{j}" if j in places else w for j, w in enumerate(base))

    # Nine changes each are 74 % of the base; those of twelve rows further on agree with others.
    rows = [(i, changed(i, {(7 * i + 13 * j) % 120 for j in range(9)})) for i in range(90)]
    rows += [(90 + i, changed(i // 3, {(5 * i + 11 * j) % 120 for j in range(8)}
                              if i % 3 else {1, 2})) for i in range(12)]
    rows += [(102 + i, changed(7, {3, 4, 5 + i})) for i in range(6)]
    monkeypatch.setattr(minhash, "LARGE", 8, raising=False)
    monkeypatch.setattr(minhash, "RARE", 12, raising=False)
    compared, verified = [], minhash._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(df, 2)) == brute(rows, 2)
    assert sum(compared[1:]) < 300, compared


def test_outlines_without_a_join_by_shingle(spark, monkeypatch):
    """What few and what many sets of a large bucket have is counted, not looked up."""
    sets = {i: [1, 2, 100 + i, 200 + i // 2, 300 + i // 5] for i in range(20)} | {50: [1, 9]}
    rest = [(7, i, 5) for i in range(20)] + [(8, 50, 2), (8, 3, 5)]
    monkeypatch.setattr(minhash, "LARGE", 8)
    monkeypatch.setattr(minhash, "RARE", 4)
    got = minhash._outlines(
        spark.createDataFrame(rest, "key long, id long, n long"),
        spark.createDataFrame(list(sets.items()), "id long, shingles array<long>"))
    assert "LeftAnti" not in got._jdf.queryExecution().toString()
    assert {(r.key, r.id): (r.common, sorted(r.rare)) for r in got.collect()} == {
        # 1, 2 and what five sets have is common, what one set has in neither.
        (7, i): (3, [200 + i // 2]) for i in range(20)} | {(8, 50): (2, []), (8, 3): (5, [])}


def test_rows_of_classes_in_one_pass(spark):
    """The rows that stay are found in one pass, so their texts are shuffled once."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, text + " x", "a"), (3, "apart", "a"),
            (None, "apart", "a"), (4, None, "a"), (4, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = minhash.representatives(df, 2)
    assert "Union" not in got._jdf.queryExecution().toString()
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, text), (3, "apart"), (4, None), (4, None)], key=str)


def test_links_without_python(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i, 60 + i))) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[3], (90, "A\tb"), (91, "a B"), (92, "\n")],
                               "doc_id long, text string")
    want = sorted(minhash.near_duplicates(df, 2).collect())
    monkeypatch.setattr(type(df), "mapInArrow", None)
    got = sorted(minhash.near_duplicates(df, 2, native=True).collect())
    assert got == want and len(got) == 16
    assert {r.component_id for r in got} == {0, 90, 92}
