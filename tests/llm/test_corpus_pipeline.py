"""The corpus pipeline: columns, what each stage keeps, planted cases, odd inputs."""

from pyspark.sql import functions as F

import corpus_pipeline
from loadlens.llm import decontaminate, minhash
from loadlens.sources.store import stored

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stored(stage(spark, kept, SF_DIR))
        assert new.columns == docs.columns and new.schema == docs.schema
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (kept, new))
        assert after <= before and new.count() == len(after)
        if name == "near_dedup":
            near = minhash.near_duplicates(kept, 2).collect()
            assert before - after == {r.doc_id for r in near if not r.kept}
        if name == "decontamination":
            found = decontaminate.matches(kept, bench).collect()
            assert before - after == {r.doc_id for r in found}
        if name == "line_dedup":
            assert before == after
        kept = new
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).collect()
    assert {r.doc_id for r in mixed} == after and all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, mixed))


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    some = docs.limit(60).collect()
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "123", "en", "s", 3),
           (None, some[0].text, "en", None, 5), (None, f"{some[0].text[:60]} of its own", "en", None, 5)]
    rows = [tuple(r) for r in some] + [tuple(some[1])] + odd
    kept = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, SF_DIR))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # The row without doc_id that copies another one goes; the one with a text of its own stays.
    assert not {9001, 9002, 9003} & set(ids) and ids.count(None) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).count() == len(ids)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF_DIR))
    assert empty.count() == 0


def test_recurring_lines_go_from_all_documents(spark):
    """Pages mostly of a common block lose it; near copies of one text do not empty each other."""
    block = [f"{w} lines of the common footer are the same in every page of this site"
             for w in ("first", "second", "third", "fourth")]

    def own(name, n):
        return " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))

    rows = [(i, "\n".join([own(f"s{chr(97 + i)}", 20), *block])) for i in range(8)]
    rows += [(10 + i, "\n".join([own(f"l{chr(97 + i)}", 150), *block])) for i in range(8)]
    copy = [own(f"c{chr(97 + i)}", 20) for i in range(12)]
    rows += [(20 + i, "\n".join([*copy[:i], f"{copy[i]} and {own(f'e{chr(97 + i)}', 1)}",
                                 *copy[i + 1:], *block])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_recurring_lines(
        spark, docs, SF_DIR).collect()}
    assert got == {i: "\n".join(text.split("\n")[:-4]) for i, text in rows}


def test_rows_of_one_doc_id_and_without(spark):
    """Near copies go by their own text; copies without doc_id go where another row stays."""
    def own(name):
        return " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(1, own("a")), (2, own("a")), (2, own("b")), (None, own("a")), (None, own("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_near_copies(spark, docs, SF_DIR).collect()
    assert sorted(map(tuple, got)) == [(1, own("a")), (2, own("b"))]


def test_clashing_columns_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(80)
    names = ["score", "held_out", "lang_pred", "spans", "_id", "_hash", "_lines", "_gone", "root",
             "own", "family", "text_hash", "best"]
    given = stored(docs.withColumns({n: F.lit(42.0) for n in names}))
    kept = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, SF_DIR))
        assert kept.schema == given.schema
    assert kept.select(*names).distinct().collect() == [tuple([42.0] * len(names))]
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stored(stage(spark, plain, SF_DIR))
    assert sorted(map(tuple, kept.select(*docs.columns).collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str)


def test_a_text_in_several_languages_stays(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    longest = {}
    for r in docs.filter("lang is not null and n_chars > 400").collect():
        longest.setdefault(r.lang, r.text[:400])
    mixed = "\n".join(longest[lang] for lang in sorted(longest)[:3])
    more = docs.unionByName(spark.createDataFrame([(77_777, mixed, None, "s", 1)], docs.schema))
    ids = {r.doc_id for r in corpus_pipeline.identified(spark, more, SF_DIR).collect()}
    assert 77_777 in ids
