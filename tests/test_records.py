"""CSV records put together from byte ranges: equal to reading each file whole, in many tasks."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.sources import readers, records

CELLS = ["plain", 'say "hi", ok', "two\nlines", "\n\n", "a,b", "", " sp ", 'z"', '""', '"', "\n", "é,\n"]


@pytest.fixture
def narrow(spark):
    """A session that cuts files into ranges of 200 bytes."""
    child = spark.newSession()
    child.conf.set("spark.sql.files.maxPartitionBytes", "200")
    child.conf.set("spark.sql.files.openCostInBytes", "1")
    child.conf.set("spark.sql.session.timeZone", "UTC")
    return child


def texts(names):
    return schemas.layout(names, lambda _: records.T.StringType())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, rng, n, end="\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["x", "y", "z"])
        for i in range(n):
            out.writerow([i, rng.choice(CELLS), rng.choice(CELLS) + "t" * rng.randrange(40)])


@pytest.mark.parametrize("seed", [1, 2])
def test_many_ranges_equal_whole_files(spark, narrow, tmp_path, seed):
    rng = random.Random(seed)
    write(tmp_path / "a.csv", rng, 250)
    write(tmp_path / "b.csv", rng, 3)
    ranges = narrow.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    assert ranges > 20
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    got = records.read_csv(narrow, str(tmp_path), texts)
    assert rows(got.drop("ord")) == rows(whole)
    order = [int(r.x) for r in got.filter(F.col("ord.file").contains("a.csv")).orderBy("ord").collect()]
    assert order == list(range(250))


def test_one_field_over_many_ranges(narrow, tmp_path):
    long = "\n".join(f'line, {i} ""' for i in range(400))
    (tmp_path / "a.csv").write_text(f'x,y\n1,"{long}"\n2,"b"\n')
    got = records.read_csv(narrow, str(tmp_path), texts).orderBy("ord").collect()
    assert [(r.x, r.y) for r in got] == [("1", long.replace('""', '"')), ("2", "b")]


def test_quotes_inside_unquoted_fields_are_characters(narrow, tmp_path):
    lines = ["x,y,z"]
    for i in range(100):
        lines.append(f'{i},5" pipe,{"q" * (i % 9)}"' if i % 3 else f'{i},"say ""5""\nthen",""')
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = records.csv_records(narrow, str(tmp_path)).orderBy("block", "row").collect()
    assert [r.record for r in got] == lines


def test_headers_blank_lines_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\r\nx,y\r\n1,2\r\n\r\n3,4")
    (tmp_path / "b.csv").write_text('y,"new\nname",x\n5,"n\r\nm",6\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("x,y\nx,y\n")
    got = records.read_csv(spark, str(tmp_path), texts)
    assert rows(got.select("x", "y", "`new\nname`")) == sorted(
        [("1", "2", None), ("3", "4", None), ("6", "5", "n\r\nm"), ("x", "y", None)], key=str)


def test_open_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y\n1,2\n')
    with pytest.raises(ValueError, match="not closed"):
        records.read_csv(spark, str(tmp_path), texts)


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_number_of_jobs_is_that_of_one_file(spark, tmp_path):
    counts = {}
    for n in (1, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.csv").write_text(f"timestamp,cpu_{i % 2}_percent\n{i},1.5\n")
        counts[n] = jobs(spark, f"files{n}", lambda f=folder: readers.read_host_metrics(spark, str(f)))
    assert counts[60] == counts[1]
    got = readers.read_host_metrics(spark, str(tmp_path / "60"))
    assert got.count() == 60 and {"cpu_0_percent", "cpu_1_percent"} <= set(got.columns)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_read_again_are_not_put_together_or_parsed_again(narrow, tmp_path):
    write(tmp_path / "a.csv", random.Random(5), 50)
    got = records.read_csv(narrow, str(tmp_path), texts)
    again = plan(got.filter("y <> ''").groupBy("z").count())
    assert "from_csv" not in again and "Join" not in again and len(rows(got)) == 50


def test_records_of_several_headers_are_parsed_in_one_pass(narrow, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n\n2,c\n')
    (tmp_path / "b.csv").write_text('y,host,x\n"d,e",h,3\n')
    (tmp_path / "c.csv").write_text('x,y\n4,"f ""g"""\n')
    got = records.read_csv(narrow, str(tmp_path), texts)
    assert "from_csv" not in plan(got) and "Join" not in plan(got)
    assert rows(got.select("x", "y", "host")) == [
        ("1", "a\nb", None), ("2", "c", None), ("3", "d,e", "h"), ("4", 'f "g"', None)]


def test_load_samples_and_spans_in_many_tasks(spark, narrow, tmp_path):
    rng = random.Random(4)
    with open(tmp_path / "run.jtl", "w", newline="") as f:
        out = csv.DictWriter(f, schemas.SAMPLE_COLUMNS)
        out.writeheader()
        for i in range(200):
            out.writerow(dict.fromkeys(schemas.SAMPLE_COLUMNS, "") | {
                "timeStamp": i, "elapsed": i, "responseMessage": rng.choice(CELLS)})
        f.write("1,2,3\r\n" + ",".join(["9"] * (len(schemas.SAMPLE_COLUMNS) + 1)) + "\r\n")
    got = readers.read_load_samples(narrow, str(tmp_path / "run.jtl"))
    assert got.rdd.getNumPartitions() > 1
    assert rows(got.select("timeStamp")) == sorted([(str(i),) for i in range(200)] + [("1",)], key=str)
    with open(tmp_path / "spans.csv", "w", newline="") as f:
        out = csv.DictWriter(f, schemas.SPAN_COLUMNS, lineterminator="\n")
        out.writeheader()
        for i in range(150):
            out.writerow(dict.fromkeys(schemas.SPAN_COLUMNS, "") | {
                schemas.SPAN_INPUT: f" q {i}\n\n?", schemas.SPAN_OUTPUT: rng.choice(CELLS) + "end\n"})
    spans = readers.read_spans(narrow, str(tmp_path / "spans.csv"))
    assert sorted(r.question for r in spans.collect()) == sorted(f"q {i}\n\n?" for i in range(150))
