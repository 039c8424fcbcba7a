"""As-of matching by time slice: no cross join and no pairs within a slice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.numbers import micros
from loadlens.sources.store import stored

_SECOND = 1_000_000


def _slice(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def _neighbours(points: DataFrame, ticks: DataFrame, width: int, reach: int) -> DataFrame:
    """For each time of ``points`` (us) the last tick at or before and the first at or after it.

    Only ticks in the same slice or up to ``reach`` slices away are seen.  ``ticks``
    holds us, ord and payload.  Ticks are first cut down to the slices that hold a
    point, then to one per clock reading, and to the closest one of the slices on
    either side.  So a slice is no larger than its clock allows however many rows
    share a reading.
    """
    at = points.select("us", _slice(F.col("us"), width).alias("slice")).distinct()
    steps = F.array(*[F.col("slice") + F.lit(i * width) for i in range(-reach, reach + 1)])
    wanted = at.select("slice").distinct().select("slice", F.explode(steps).alias("tick_slice"))
    side = F.signum(F.col("tick_slice") - F.col("slice"))
    outward = F.struct(F.when(F.col("side") < 0, -F.col("us")).otherwise(F.col("us")), "ord")
    hits = (
        ticks.withColumn("tick_slice", _slice(F.col("us"), width))
        .join(wanted, "tick_slice")
        .withColumn("side", side)
        .groupBy("slice", "side", F.when(F.col("side") == 0, F.col("us")).alias("reading"))
        .agg(F.min_by(F.struct("us", "ord", "payload"), outward).alias("hit"))
        .select("slice", "hit.us", "hit")
    )
    marked = at.withColumn("is_point", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    upward = Window.partitionBy("slice").orderBy("us").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    downward = Window.partitionBy("slice").orderBy(F.desc("us")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        marked.withColumn("before", F.last("hit", ignorenulls=True).over(upward))
        .withColumn("after", F.last("hit", ignorenulls=True).over(downward))
        .filter("is_point")
        .select("us", "before", "after")
    )


def nearest_match(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    order_by: list[str],
    payload: list[Column],
    tolerance: float,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Left rows with the right row nearest in time, at most ``tolerance`` seconds away.

    Equal distances go to the row first in ``order_by``; left rows without a match
    are dropped.  ``start`` and ``end`` (columns of ``left``) bound the times a match
    may have, both ends included, a missing end being open.  The matched row comes
    as struct column ``match`` with ``us``, ``ord`` and ``payload``.
    """
    tol = int(tolerance * _SECOND)
    ticks = right.filter(F.col(right_ts).isNotNull()).select(
        micros(right_ts).alias("us"),
        F.struct(*order_by).alias("ord"),
        F.struct(*payload).alias("payload"),
    )
    timed = left.filter(F.col(left_ts).isNotNull()).withColumn("us", micros(left_ts))
    sides = _neighbours(timed.select("us"), ticks, max(tol, _SECOND), reach=1)

    def usable(side: str) -> Column:
        us = F.col(f"{side}.us")
        ok = F.abs(us - F.col("us")) <= tol
        if start is not None:
            ok = ok & F.coalesce(us >= micros(start), F.lit(True))
        if end is not None:
            ok = ok & F.coalesce(us <= micros(end), F.lit(True))
        return F.when(ok, F.struct(
            F.abs(us - F.col("us")).alias("gap"), F.col(f"{side}.ord").alias("ord"),
            us.alias("us"), F.col(f"{side}.payload").alias("payload")))

    return (
        timed.join(sides, "us")
        .withColumn("match", F.least(usable("before"), usable("after")))
        .filter(F.col("match").isNotNull())
        .drop("us", "before", "after")
    )


def _next_ticks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of a range, latest first, with ticks before points: each point with its next tick.

    The last row has the range's earliest tick and no point.
    """
    part = earliest = None
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("next", pa.int64())])
    for batch in batches:
        times, kinds = (batch.column(c).to_pylist() for c in ("us", "is_tick"))
        part = batch.column("part")[0].as_py() if batch.num_rows else part
        found, ticks = [], []
        for us, is_tick in zip(times, kinds, strict=True):
            if is_tick:
                earliest = us
            else:
                found.append(us)
                ticks.append(earliest)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(found), pa.int32()), pa.array(found, pa.int64()),
             pa.array(ticks, pa.int64())], schema=schema)
    if earliest is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "at": None, "next": earliest}], schema)


def first_at_or_after(
    points: DataFrame, ticks: DataFrame, point_ts: str, tick_ts: str, name: str,
) -> DataFrame:
    """Add the first tick time at or after each point, missing where there is none.

    A merge in ranges of time: distinct times of points and ticks are range-partitioned, and each
    task goes through its range once.  A point after the last tick of its range takes the first
    tick of the next range that has one; these are one row for each range.  The ticks are read
    once, whatever the number of points, and no time passes the driver.
    """
    timed = points.withColumn("_us", micros(point_ts))
    times = timed.select(F.col("_us").alias("us"), F.lit(False).alias("is_tick")).unionByName(
        ticks.select(micros(tick_ts).alias("us"), F.lit(True).alias("is_tick"))).filter(
        "us is not null").distinct()
    found = stored(times.repartitionByRange("us").sortWithinPartitions(
        F.desc("us"), F.desc("is_tick")).withColumn("part", F.spark_partition_id()).mapInArrow(
        _next_ticks, "part int, at long, next long"))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    ranges = found.groupBy("part").agg(
        F.min(F.when(F.col("at").isNull(), F.col("next"))).alias("first"))
    carried = ranges.select("part", F.min("first").over(later).alias("carried"))
    nexts = found.filter("at is not null").join(carried, "part").select(
        F.col("at").alias("_at"), F.coalesce("next", "carried").alias("_next"))
    return timed.join(nexts, timed["_us"] == nexts["_at"], "left").withColumn(
        name, F.timestamp_micros("_next")).drop("_us", "_at", "_next")
