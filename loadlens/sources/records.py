"""CSV records whose quoted fields may hold line breaks, read in many tasks per file.

A file is read line by line in byte ranges.  Whether a range begins inside a quoted field is not
known in it, so every line is followed under both assumptions; one row per range then tells which
one holds, range after range, and only the lines of records that span lines are brought together.
"""

from __future__ import annotations

import csv
import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.sources.store import drop_folder, new_folder, stored

_LINE = ("file string, block long, row long, value string, begin0 boolean, end0 boolean, "
         "nth0 long, begin1 boolean, end1 boolean, nth1 long, lead boolean")
_RANGE = "file string, block long, inside boolean, owner_block long, owner_nth long"


def _open_at_end(delimiter: str) -> Callable[[str], bool]:
    """Whether a line that begins outside of quotes ends inside a quoted field.

    A quote opens a field only at its beginning; elsewhere in an unquoted field it is a character.
    """
    d = re.escape(delimiter)
    quoted = r'"(?:[^"]|"")*+'
    pattern = re.compile(rf'(?:(?:{quoted}"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+{quoted}\Z')
    return lambda line: pattern.match(line) is not None


def _states(
    state: tuple[bool, bool], values: list[str], ends_open: Callable[[str], bool],
) -> Iterator[tuple[bool, bool]]:
    """Whether a line follows inside a field, after each of ``values``, under both assumptions."""
    for value in values:
        first = ends_open(f'"{value}' if state[0] else value)
        # Once both assumptions agree they go on alike.
        second = first if state[0] == state[1] else ends_open(f'"{value}' if state[1] else value)
        state = first, second
        yield state


def _parts(batch: pa.RecordBatch) -> list[int]:
    """Where the byte ranges of a batch begin, and its end."""
    file = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
    block = batch.column("block").to_numpy()
    changes = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    return [0, *changes.tolist(), batch.num_rows]


def _follower(delimiter: str):
    """Number the records of each byte range under both assumptions.

    Only lines with a quote are looked at one by one.
    """
    ends_open = _open_at_end(delimiter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row, state, nth, lead = None, 0, (False, True), [0, 0], None
        for batch in batches:
            starts = _parts(batch) if batch.num_rows else []
            for start, stop in itertools.pairwise(starts):
                part, n = batch.slice(start, stop - start), stop - start
                file, block = (part.column(c)[0].as_py() for c in ("file", "block"))
                if here != (file, block):
                    here, row, state, nth, lead = (file, block), 0, (False, True), [0, 0], None
                value = part.column("value")
                marks = np.flatnonzero(
                    pc.match_substring(value, '"').to_numpy(zero_copy_only=False))
                states = [state, *_states(state, value.take(marks).to_pylist(), ends_open)]
                lengths = np.diff(np.concatenate([[-1], marks, [n - 1]]))
                out = []
                for i in (0, 1):
                    begin = np.repeat(np.array([s[i] for s in states]), lengths)
                    numbers = nth[i] + np.cumsum(~begin)
                    out += [begin, np.append(begin[1:], states[-1][i]), numbers]
                    nth[i] = int(numbers[-1])
                if lead is None and block == 0:
                    lead = next((out[2][i] for i in range(n) if not _is_blank(value[i].as_py())),
                                None)
                leads = out[2] == lead if lead is not None and block == 0 else np.zeros(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("file"), part.column("block"),
                     pa.array(row + np.arange(n, dtype=np.int64)), value,
                     *map(pa.array, out), pa.array(leads)],
                    ["file", "block", "row", "value", "begin0", "end0", "nth0", "begin1", "end1",
                     "nth1", "lead"])
                row, state = row + n, states[-1]

    return run


def _is_blank(line: str) -> bool:
    return not line.removesuffix("\r").strip(" ")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range of a file, in order: does it begin inside a field, and of which record."""
    names = ["file", "block", "inside", "owner_block", "owner_nth"]
    for batch in batches:
        out: list[tuple] = []
        for file, ranges in zip(*(batch.column(c).to_pylist() for c in ("file", "ranges")),
                                strict=True):
            inside, owner = False, (None, None)
            for part in ranges:
                out.append((file, part["block"], inside, *owner))
                which = "1" if inside else "0"
                if part[f"nth{which}"]:
                    owner = part["block"], part[f"nth{which}"]
                inside = part[f"end{which}"]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _followed(
    spark: SparkSession, path: str | Sequence[str], delimiter: str, folder: str | None = None,
) -> DataFrame:
    """All lines with their place, followed under both assumptions, kept in the shared folder.

    ``lead`` marks the lines of a file's first record that is not blank.
    """
    text = spark.read.text(path if isinstance(path, str) else list(path), lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    return stored(text.mapInArrow(_follower(delimiter), _LINE), folder)


def _put_together(parts: DataFrame, at: Column, nth: Column) -> DataFrame:
    """The lines of each record that spans lines, as one record."""
    lines = parts.groupBy("file", at.alias("at"), nth.alias("nth")).agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "value", "end"))).alias("lines"))
    return lines.select(
        "file", F.col("lines")[0]["block"].alias("block"), F.col("lines")[0]["row"].alias("row"),
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"),
        F.element_at("lines", -1)["end"].alias("cut"))


def _shown(records: DataFrame) -> DataFrame:
    """Records without the carriage return of their line end; blank ones go."""
    record = F.col("record")
    return records.withColumn("record", F.when(
        record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record)).filter(
        F.trim("record") != "")


def _records(lines: DataFrame) -> DataFrame:
    ranges = lines.groupBy("file", "block").agg(
        F.max_by("end0", "row").alias("end0"), F.max_by("end1", "row").alias("end1"),
        F.max("nth0").alias("nth0"), F.max("nth1").alias("nth1"))
    decided = stored(ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(
        "block", "end0", "end1", "nth0", "nth1"))).alias("ranges")).mapInArrow(_decided, _RANGE))
    chosen = {c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
              for c in ("begin", "end", "nth")}
    known = lines.join(decided, ["file", "block"]).select(
        "file", "block", "row", "value", "owner_block", "owner_nth",
        *[c.alias(name) for name, c in chosen.items()])
    own = F.col("nth") > 0
    whole = known.filter("not begin and not end").select(
        "file", "block", "row", F.col("value").alias("record"))
    return _shown(whole.unionByName(_put_together(
        known.filter("begin or end"), F.when(own, F.col("block")).otherwise(F.col("owner_block")),
        F.when(own, F.col("nth")).otherwise(F.col("owner_nth"))).drop("cut")))


def csv_records(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """(file, block, row, record): the records of CSV files, blank ones left out.

    ``block`` and ``row`` tell where a record begins.  The files are read once, in byte ranges of
    spark.sql.files.maxPartitionBytes at most; their lines are kept as Parquet in the shared
    folder, so ranges can't change between the steps.  Quotes are doubled inside quoted fields;
    line breaks in them stay as they are.  The ranges of a file, one row each, meet in one task.
    """
    return _records(_followed(spark, path, delimiter))


def _heads(lines: DataFrame) -> DataFrame:
    """(file, head, at): the first record of each file, from the lines of its first range."""
    first = lines.filter("lead").select(
        "file", "block", "row", "value", F.col("begin0").alias("begin"),
        F.col("end0").alias("end"), F.col("nth0").alias("nth"))
    whole = first.filter("not begin and not end").select(
        "file", "block", "row", F.col("value").alias("record"), F.lit(False).alias("cut"))
    joined = _put_together(first.filter("begin or end"), F.col("block"), F.col("nth"))
    place = F.struct("block", "row")
    return _shown(whole.unionByName(joined)).groupBy("file").agg(
        F.min_by("record", place).alias("head"), F.min(place).alias("at"),
        F.min_by("cut", place).alias("cut"))


def _ddl(layout: T.StructType) -> str:
    return ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in layout.fields)


def _by_place(layout: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(f"c{i}", f.dataType) for i, f in enumerate(layout.fields)])


def read_csv(
    spark: SparkSession, path: str | Sequence[str],
    layout: Callable[[list[str]], T.StructType], delimiter: str = ",", **options: str,
) -> DataFrame:
    """Rows of CSV files by column name, with ``ord``, which sorts them as they stand in the files.

    The first record of each file names its columns, and ``layout`` gives their types.  Headers
    are found in one job, whatever the number of files; files with different ones are put
    together by column name, and columns a file lacks are missing in its rows.  The parsed rows
    are kept as Parquet in place of the lines, however often they are read.
    """
    folder = new_folder(spark)
    lines = _followed(spark, path, delimiter, folder)
    heads = stored(_heads(lines))
    found = sorted({(r.head, r.cut) for r in heads.select("head", "cut").distinct().collect()})
    if not found:
        raise ValueError(f"no rows in {path}")
    if any(cut for _, cut in found):
        raise ValueError(f"a quote in the first record of a file in {path} is not closed")
    layouts = [layout(next(csv.reader([head], delimiter=delimiter))) for head, _ in found]
    number = F.coalesce(*[F.when(F.col("head") == head, i) for i, (head, _) in enumerate(found)])
    begins = heads.select(F.col("file").alias("_file"), number.alias("_head"), "at")
    rows = _records(lines).join(begins, F.col("file") == F.col("_file")).filter(
        F.struct("block", "row") != F.col("at"))
    # Every record is parsed once, into the columns of its own header, named by their places.
    parsed = [F.from_csv("record", F.lit(_ddl(kinds)), {
        "sep": delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
        **options}).cast(_by_place(kinds)) for kinds in layouts]
    kept = stored(rows.select(
        F.struct("file", "block", "row").alias("ord"), "_head",
        *[F.when(F.col("_head") == i, row).alias(f"_row{i}") for i, row in enumerate(parsed)]))
    drop_folder(spark, folder)
    frames = [kept.filter(F.col("_head") == i).select(
        *[F.col(f"_row{i}")[f"c{at}"].alias(f.name) for at, f in enumerate(kinds.fields)], "ord")
        for i, kinds in enumerate(layouts)]
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole
