"""Merkle manifest against a plain rebuild, its SQL, and the odd inputs."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loadlens.llm import merkle
from loadlens.llm.queries import op11_manifest

sys.path.append(str(Path(__file__).parents[1]))
from oracle import connect, differences  # noqa: E402

LAYOUT = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(*values):
    return ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]


def tree(leaves):
    """Root and, for each leaf, the siblings (before, behind) from the leaf up."""
    level, below, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, held = [], []
        for start in range(0, len(level), 3):
            run = level[start:start + 3]
            for slot in range(len(run)):
                for leaf in below[start + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            above.append(h(*run))
            held.append([x for b in below[start:start + 3] for x in b])
        level, below = above, held
    return level[0], paths


def rebuilt(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the query's rows, sorted as text."""
    by_source = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*fields(doc_id, source, lang, n, text))
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if text is not None and even else text
        by_source.setdefault((source is not None, (source or "").encode()), []).append(
            ((doc_id is not None, doc_id or 0), leaf, doc_id,
             h(*fields(doc_id, source, lang, n, changed))))
    sources = sorted(by_source)
    inner = [tree([r[1] for r in sorted(by_source[s], key=lambda r: r[:2])]) for s in sources]
    root, outer = tree([i[0] for i in inner])
    out = []
    for s, (subroot, paths), over in zip(sources, inner, outer, strict=True):
        for row, path in zip(sorted(by_source[s], key=lambda r: r[:2]), paths, strict=True):
            fold = row[3]
            for before, behind in path + over:
                fold = h(before, fold, behind)
            proof = h(*[a + b for a, b in path + over])
            out.append((row[2], row[1], subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_is_the_rebuilt_manifest(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()
    got = result(op11_manifest(spark, sf_dir))
    assert got == rebuilt([tuple(r) for r in rows])
    assert {r[6] for r in got} == {True, False}


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(op11_manifest(spark, sf_dir), connect(sf_dir), merkle.SQL) == []


def test_hot_source_odd_fields_and_ties(spark):
    rows = [(i, f"line {i}\nnext", "en", "hot", i) for i in range(700)]
    rows += [(i, None, None, f"s{i:03}", None) for i in range(40)]  # trees of one leaf
    rows += [(None, "a\nb", "de", None, 3), (None, None, None, None, None), (3, "", "", "", 0),
             (3, "\n", "", "", 0), (3, "\n", "", "", 0), (3, "\n", "", "", 0), (3, "z", "", "", 0),
             (-5, "é\nü", "fr", "ä", 2), (2, "é\r\nü", "fr", "z", 2), (8, "x\n" * 300_000, "x", "Z", 1)]
    df = spark.createDataFrame(rows, LAYOUT).repartition(5)
    clash = df.withColumns({c: F.lit("clash") for c in (
        "pos", "tree", "node", "n", "c0", "path", "place", "changed", "total", "root", "_part")})
    assert result(merkle.manifest(clash).drop("path")) == rebuilt(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_short_last_runs(spark, n):
    rows = [(i, f"{i}", "en", "one", 1) for i in range(n)]
    assert result(merkle.manifest(spark.createDataFrame(rows, LAYOUT)).drop("path")) == rebuilt(rows)


def test_any_change_shows(spark):
    """Whatever the tampering, the path of a changed row leads elsewhere, that of others does not."""
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 1) for i in range(20)]
    got = merkle.manifest(spark.createDataFrame(rows, LAYOUT), lambda doc_id, text: F.when(
        doc_id == 7, F.concat(text, F.lit(" "))).otherwise(text)).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]
    assert all(len(r.path) == len(got[0].path) for r in got)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], LAYOUT)).collect() == []
