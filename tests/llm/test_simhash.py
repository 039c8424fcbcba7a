"""SimHash near-duplicates against brute force, long posting lists, and the odd inputs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loadlens.llm import simhash
from loadlens.llm.queries import op13_simhash


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """The smallest id reachable of each (id, fingerprint), by comparing all pairs."""
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    return {i: least[find(p)] for i, p in prints.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_is_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    want = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert any(i != c for i, c in want.items())


def linked(spark, prints):
    """Components of the library's links over a table of fingerprints."""
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    label = {r.node % (1 << 64): r.component for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(label.get(p, f"own {p}"), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def brute(prints):
    groups = {}
    for p, c in classes({p: p for p in prints}).items():
        groups.setdefault(c, set()).add(p)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("few", [0, 2, 64])
def test_long_lists_lose_no_link(spark, monkeypatch, few):
    """Fingerprints that share five bytes, most of them farther than three bits apart."""
    monkeypatch.setattr(simhash, "_FEW", few)
    rng = random.Random(few)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(60):
        bits = rng.sample(range(24), rng.choice([4, 5, 6, 7]))
        near = base ^ sum(1 << b for b in bits)
        prints |= {near, near ^ sum(1 << b for b in rng.sample(range(64), 3))}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    assert linked(spark, sorted(prints)) == brute(prints)


def test_every_pair_within_the_radius_shares_a_list(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))))
    every = {x for p in pairs for x in p}
    groups = linked(spark, sorted(every))
    assert groups == {frozenset(p) for p in pairs}


def test_masks_of_a_large_group(spark):
    """Rows of the masks grow with the members: one for each choice of three of 24 bits."""
    members = spark.range(100).select(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("held"),
                                      F.col("id").alias("fp"))
    rows = simhash._masked(members)
    assert rows.count() == 100 * 2024
    assert rows.groupBy("cleared", "rest").count().agg(F.max("count")).head()[0] <= 8


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\r\n\x0b\x0c", "x"), (4, "One", None), (5, "oNE ", "x"),
        (6, "one  two\tthree", "x"), (7, "ONE two three", "x"), (8, "ÉTÉ one", "x"),
        (9, "été one", "x"), (9, "a b c d", "x"), (9, "a b c d", "x"), (None, "a b c d", "x"),
        (None, "only here is this", "x"), (10, "long word " * 150_000, "x"),
        (11, "LONG word " * 150_000, "x"), (12, "x\x00y z", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn(
        "component_id", F.lit("clash"))
    got = sorted(simhash.near_duplicates(df).collect(),
                 key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint))
    want = sorted(((i, f"{fingerprint(t):016x}") for i, t, _ in rows),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.fingerprint) for r in got] == want
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    named = {p: next(iter(c)) for p, c in by_print.items() if len(c) == 1}
    assert named["0" * 16] == 1
    assert named[f"{fingerprint('One'):016x}"] == 4
    assert named[f"{fingerprint('one two three'):016x}"] == 6
    assert named[f"{fingerprint('a b c d'):016x}"] == 9
    assert named[f"{fingerprint('long word ' * 150_000):016x}"] == 10
    assert named[f"{fingerprint('only here is this'):016x}"] is None


def test_hashes_are_the_engines_own(spark):
    """A text of one shingle has its hash as fingerprint, the same as Spark's function gives."""
    df = spark.createDataFrame([(1, "Wörter sind\tlang")], "doc_id long, text string")
    got = simhash.near_duplicates(df).head().fingerprint
    own = spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit("wörter sind lang"))))).head()[0]
    assert got == own.rjust(16, "0")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
