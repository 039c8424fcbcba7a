"""Telemetry shaping: core sums, smoothing, run markers and chart tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import schemas
from loadlens.functions.numbers import epoch_ms_to_timestamp
from loadlens.plans.nearest import first_at_or_after
from loadlens.plans.position import with_position
from loadlens.sources.store import stored

# Fixed value: per-core columns of a host.
_CORE = re.compile(r"cpu_.*_percent")


def core_columns(df: DataFrame) -> list[str]:
    """Per-core CPU columns."""
    return [c for c in df.columns if _CORE.fullmatch(c)]


def with_time(df: DataFrame) -> DataFrame:
    """Add ``datetime`` and the clock label ``time_str`` to epoch-ms ``timestamp``.

    Without a timestamp the label is the row's place in file order.
    """
    if "timestamp" not in df.columns:
        placed = with_position(df, ["ord"], position="_place").drop("total")
        return placed.withColumn(
            "time_str", F.concat(F.lit("Point "), F.col("_place"))).drop("_place")
    ts = F.col("timestamp")
    if not isinstance(df.schema["timestamp"].dataType, T.TimestampType):
        ts = epoch_ms_to_timestamp(ts)
    return df.withColumn("datetime", ts).withColumn(
        "time_str", F.date_format("datetime", "HH:mm:ss"))


def cores_sum(df: DataFrame, fallback: Column) -> Column:
    """Sum over cores, missing ones as 0; the host total, else ``fallback``, without cores."""
    cores = core_columns(df)
    if cores:
        parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cores]
        return sum(parts[1:], parts[0])
    if "cpu_percent_total" in df.columns:
        return F.col("cpu_percent_total").cast("double")
    return fallback


def cpu_cores_sum(df: DataFrame) -> DataFrame:
    """Add ``cpu_cores_sum``; 0 when the host reports no CPU at all."""
    return df.withColumn("cpu_cores_sum", cores_sum(df, F.lit(0.0)))


def with_capacity(df: DataFrame) -> DataFrame:
    """Add the core count and the highest values cores, memory and GPU can reach."""
    cores = len(core_columns(df))
    if not cores and "cpu_percent_total" in df.columns:
        cores = 1
    caps = {"cpu_cores_count": F.lit(cores), "cpu_max_possible": F.lit(max(cores, 1) * 100)}
    if "memory_percent" in df.columns:
        caps["memory_max_percent"] = F.lit(100)
    if "gpu_0_util_percent" in df.columns:
        caps["gpu_max_util_percent"] = F.lit(100)
    return df.withColumns(caps)


def moving_average(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], group: Sequence[str] = (),
    n: int = 5, chunk: int = 4096,
) -> DataFrame:
    """Add ``<col>_ma``, the centred ``n``-row average in ``order_by`` order per group.

    Missing values are ignored; at the ends the average is over the rows there are.
    Rows get their ``position`` in the group, unless :func:`with_position` has given
    it; each chunk of positions is then averaged on its own together with the few
    rows just outside it, so one long run spreads over many tasks.
    """
    after = (n - 1) // 2
    before = n - 1 - after
    placed = df if "position" in df.columns else with_position(df, order_by, group).drop("total")
    offset = F.pmod(F.col("position"), F.lit(chunk))
    home = F.col("position") - offset
    homes = F.array_compact(F.array(
        home,
        F.when(offset >= chunk - before, home + chunk),
        F.when(offset < after, home - chunk),
    ))
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    around = Window.partitionBy(*group, "_chunk").orderBy("position").rowsBetween(-before, after)
    return (
        spread.withColumns({f"{c}_ma": F.avg(c).over(around) for c in cols})
        .filter("_chunk = _home")
        .drop("_home", "_chunk")
    )


def file_order(bins: DataFrame) -> str:
    """Column that tells the order of a run's rows: that of its file, else the user bin."""
    return "ord" if "ord" in bins.columns else "user_bin"


def run_starts(bins: DataFrame, order_by: str | None = None) -> DataFrame:
    """Start of each run: its bin 0, else its first row in ``order_by`` order.

    The order is that of the run file if the bins were read from one.
    """
    order_by = order_by or file_order(bins)
    start = F.min_by("bin_start_timestamp", order_by)
    if "user_bin" in bins.columns:
        zero = F.when(F.col("user_bin") == 0, F.col(order_by))
        start = F.coalesce(F.min_by("bin_start_timestamp", zero), start)
    return bins.groupBy("run_id").agg(start.alias("run_start"))


def snap_run_starts(starts: DataFrame, metrics: DataFrame, ts: str = "datetime") -> DataFrame:
    """Move each run start to the first metric row at or after it, if there is one."""
    return first_at_or_after(starts, metrics, "run_start", ts, "_snapped").select(
        "run_id", "run_start", F.coalesce("_snapped", "run_start").alias("marker"))


def available_metrics(
    df: DataFrame, catalogue: Sequence[tuple[str, str, str]] = tuple(schemas.EMISSION_METRICS)
) -> list[tuple[str, str, str]]:
    """Entries of a metric catalogue whose column exists."""
    return [entry for entry in catalogue if entry[0] in df.columns]


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per id and metric, as ``metric`` and ``value``."""
    plain = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return plain.unpivot(list(ids), list(metrics), "metric", "value")


def metric_series(
    df: DataFrame,
    starts: DataFrame,
    ts: str,
    marker: str = "run_start",
    catalogue: Sequence[tuple[str, str, str]] = tuple(schemas.EMISSION_METRICS),
) -> DataFrame:
    """Long chart table: each available metric over time, and a marker row per run start."""
    found = available_metrics(df, catalogue)
    if not found:
        raise ValueError("no metric columns")
    titles = F.create_map(*[F.lit(x) for c, t, _ in found for x in (c, t)])
    units = F.create_map(*[F.lit(x) for c, _, u in found for x in (c, u)])
    series = unpivot_metrics(df, [ts], [c for c, _, _ in found]).select(
        F.lit("series").alias("kind"), F.col(ts).alias("at"), "metric",
        titles[F.col("metric")].alias("title"), units[F.col("metric")].alias("unit"), "value")
    marks = starts.select(
        F.lit("run_start").alias("kind"), F.col(marker).alias("at"),
        F.col("run_id").cast("int").alias("run_id"))
    return series.unionByName(marks, allowMissingColumns=True)


def telemetry_summary(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Time range, row count and value ranges of CPU, memory and GPU."""
    ranges = [
        fn(c).alias(f"{c}_{which}")
        for c in ("cpu_cores_sum", "memory_percent", "gpu_0_util_percent") if c in df.columns
        for which, fn in (("min", F.min), ("max", F.max))
    ]
    return df.agg(
        F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
        F.count(F.lit(1)).alias("points"), *ranges)


def sample_ticks(df: DataFrame, order_by: Sequence[str], k: int = 8) -> DataFrame:
    """Up to ``k`` evenly spaced rows with their ``position``.

    Selection by refinement: rows are counted by value of the first order column, and the counts
    by range of values; only ranges that hold a wanted position are looked into, which gives the
    ``k`` values at most whose rows are read again and given their positions.  A hot value is one
    count, and its rows are range-partitioned by the other columns.  A missing value comes first.
    """
    first, *others = order_by
    counts = df.groupBy(F.col(first).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ranges = stored(counts.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    total = ranges.agg(F.sum("n")).first()[0] or 0
    steps = min(k, total) - 1
    wanted = sorted({i * (total - 1) // max(steps, 1) for i in range(steps + 1)})
    if not wanted:
        return df.limit(0).withColumn("position", F.lit(0).cast("long"))
    # As many values as wanted positions at most.
    held = stored(_holding(ranges, wanted))
    rows = df.join(F.broadcast(held), F.col(first).eqNullSafe(F.col("_at"))).withColumn(
        "_tie", F.monotonically_increasing_id())
    placed = with_position(rows, [*others, "_tie"], group=["_before"], total="_total")
    return placed.withColumn("position", F.col("position") + F.col("_before")).filter(
        F.array_contains("_places", F.col("position"))).select(*df.columns, "position")


def _holding(ranges: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """The values that hold wanted rows, with the rows before them and the positions in them.

    ``ranges`` has the count ``n`` of each value ``at`` and the number ``part`` of its range.
    """
    sums = ranges.groupBy("part").agg(F.sum("n").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("begin", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))

    def inside(begin: str, size: str) -> Column:
        return F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (
            w >= F.col(begin)) & (w < F.col(begin) + F.col(size)))

    holding = begun.filter(F.size(inside("begin", "sum")) > 0).select("part", "begin")
    smaller = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("n").over(smaller), F.lit(0))
    return ranges.join(holding, "part").withColumn("_before", before).select(
        F.col("at").alias("_at"), "_before", inside("_before", "n").alias("_places")).filter(
        "size(_places) > 0")
