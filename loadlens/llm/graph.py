"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.sources.store import new_folder, scratch, stored

# Links that one task joins up at a time.
LINKS = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (a, b) and the smallest one it reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            return nodes, nodes[root]
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as links (b, a) of every node to the smallest one reached, itself too."""
    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, root = _stars(*(table.column(c).to_numpy() for c in "ab"))
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(nodes)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= LINKS:
            yield sent(held)
            held, n = [], 0
    if held:
        yield sent(held)


def components(links: DataFrame, native: bool = False) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Each task first joins up its own links, up to LINKS at a time, so that a group with many
    links is left with one for each node and task.  If no more than LINKS are left, they are
    joined up likewise.  Otherwise every round takes the smallest label among the neighbours and
    then follows the label's own label, so a chain shrinks by half.  Each round is written to the
    shared folder; only the number of changed labels reaches the driver.  No links give no rows.
    With ``native`` there are only such rounds, and no Python runs on the executors; a node
    linked with itself alone gives no row then.
    """
    spark = links.sparkSession
    path = new_folder(spark)
    with scratch(spark):
        given = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
        if native:
            return stored(_spread(stored(given)), path)
        few = stored(given.mapInArrow(_joined_up, "a long, b long"))
        if few.count() <= LINKS:
            labels = few.repartition(1).mapInArrow(_joined_up, "a long, b long").select(
                F.col("b").alias("node"), F.col("a").alias("component"))
        else:
            labels = _spread(few)
        return stored(labels, path)


def _spread(links: DataFrame) -> DataFrame:
    both = stored(links.filter("a <> b").union(links.filter("a <> b").select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a")
                .agg(F.min("label").alias("m")))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = stored(lower.join(ahead, lower.next == ahead.at, "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("label"),
            F.col("label").alias("was")))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
