"""Mixing sources to target shares by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.sources.store import stored

MAX_EPOCHS = 3
BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of words of a text; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: shares of the total by weights 1, 2, 3, 1 ... in source order.

    A target stops at ``epochs`` times its source's size and the excess goes to the others by
    weight.  With sources in the order of cap to weight, the level at which the capped ones
    before a source leave the rest to the others is a running sum; the first level that its own
    source can bear holds for all.  The windows run over one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.select(
        "source", "source_size",
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double").alias("weight"),
        (epochs * F.col("source_size")).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(
        after)
    levels = ranked.select("*", level.alias("level"), F.row_number().over(order).alias("at"))
    borne = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"),
                         F.struct("at", "level"))).over(Window.partitionBy())
    return levels.select(
        "source", "source_size",
        F.least(F.col("weight") * F.coalesce(borne["level"], F.lit(float("inf"))),
                F.col("cap")).alias("target"))


def exponential_key(seed: int, quality: Column, *parts: Column) -> Column:
    """-ln(u) / quality with u in (0, 1] from the parts' hash: the smallest keys are the sample."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("-"))
                                                for p in parts))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(float(1 << 52))) / quality


def mix(sizes: DataFrame, seed: int = 1, epochs: int = MAX_EPOCHS,
        buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target and taken from (doc_id, source, size, quality).

    taken is the number of words the mix takes of a row, repeats counted: as many complete
    epochs of the source as the target holds, then rows in the order of their exponential keys
    until the rest of the target is full; the row that passes it is cut.  So a source's taken
    words are its target, rounded down.

    The order within a source is found by key bucket: sums by bucket are added up in a small
    table, and rows are sorted only in the one bucket of a source where the target ends, so a
    source that holds most rows is not sorted in one task.  A quality that is null or not above
    0 counts as 1.  Rows with a null doc_id or source, of size 0, or repeated are rows like
    others; equal rows are interchangeable.  The result depends on the rows and the seed alone.
    """
    weight = F.when(F.col("quality") > 0, F.col("quality").cast("double")).otherwise(F.lit(1.0))
    keyed = sizes.select("doc_id", "source", "size", exponential_key(
        seed, weight, F.col("doc_id"), F.col("size")).alias("key"))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1))
    rows = stored(keyed.withColumn("bucket", bucket.cast("int")))
    targets = source_targets(rows, epochs)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    complete = F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    begun = sums.withColumn("begin", F.coalesce(
        F.sum("bucket_size").over(running), F.lit(0)).cast("long"))
    state = begun.join(targets.withColumnRenamed("source", "s"),
                       F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target",
        complete.alias("complete"), "begin", "bucket_size",
        (F.floor("target").cast("long") - complete * F.col("source_size")).alias("rest"))
    state = stored(state.withColumn("cut", (F.col("begin") < F.col("rest")) & (
        F.col("rest") < F.col("begin") + F.col("bucket_size"))))
    placed = rows.join(state, F.col("source").eqNullSafe(F.col("s"))
                       & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy(
        "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("begin") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = placed.filter("cut").withColumn(
        "more", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    full = placed.filter("not cut").withColumn("more", F.when(
        F.col("begin") < F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    return full.unionByName(part).select(
        "doc_id", "size", "source_size", "target",
        (F.col("complete") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def sized(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size and quality: 2 for a document labelled good, 0.5 for bad, else 1.

    Several labels of one document are averaged.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("marked")).agg(F.avg("quality").alias("mean"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                      words(F.col("text")).alias("size"))
    return own.join(marks, own.doc_id == marks.marked, "left").select(
        "doc_id", "source", "size", F.coalesce(0.5 + 1.5 * F.col("mean"), F.lit(1.0))
        .alias("quality"))


SQL = r"""
WITH sized AS (
  SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.source,
    CAST(COALESCE(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    COALESCE(0.5 + 1.5 * CAST(l.mean AS DOUBLE), 1.0) AS quality
  FROM documents d LEFT JOIN (
    SELECT doc_id, avg(quality) AS mean FROM labels
    WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)
), keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('1:' || COALESCE(CAST(doc_id AS VARCHAR), '-') ||
    ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0)
    / quality AS key
  FROM sized
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 3 AS cap,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - COALESCE(sum(cap) OVER before, 0.0))
      / sum(weight) OVER after AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS spot
  FROM ranked
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size, least(weight * COALESCE(
    (SELECT level FROM levels WHERE level <= cap / weight ORDER BY spot LIMIT 1),
    CAST('Infinity' AS DOUBLE)), cap) AS target
  FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0
    END AS complete
  FROM targets
), placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, s.complete,
    CAST(floor(s.target) AS BIGINT) - s.complete * s.source_size AS rest,
    COALESCE(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
  CAST(complete * size + greatest(0, least(size, rest - begin)) AS BIGINT) AS taken
FROM placed
"""
