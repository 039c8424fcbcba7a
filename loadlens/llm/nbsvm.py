"""Text quality by a support vector machine on n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.llm.words import U64, Words, constants, mix, slices
from loadlens.sources.store import stored

BITS = 18           # feature buckets: 2 ** BITS
MAX_ROWS = 10_000   # labels learned from, at most, and labelled rows
MAX_FEATURES = 1 << 26   # features of all rows learned from, at most
_LAST = np.uint64(64 - BITS)


class Model(NamedTuple):
    """Weights by feature bucket, bias, and slope and offset of the score's logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _kinds() -> np.ndarray:
    """Class of a byte: lower, upper, digit, symbol, mark of a sentence, beyond ASCII."""
    kinds = np.full(256, 3, np.uint64)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 0, 1, 2, 5
    kinds[[ord(c) for c in ".,;:?"]] = 4
    return kinds


def _features(texts: pa.Array) -> list[np.ndarray]:
    """Distinct feature buckets of each text.

    Features are words, pairs of words, and runs of one to three word shapes.  A shape is the
    class of the first and of the last byte, and whether the word repeats the one before.
    """
    words = Words(texts)
    h, bounds = words.hash, words.bounds
    if not len(h):
        return [np.zeros(0, np.int64) for _ in range(len(bounds) - 1)]
    kinds = _kinds()
    again = np.zeros(len(h), U64)
    again[1:] = h[1:] == h[:-1]
    starts = bounds[:-1][bounds[:-1] < len(h)]
    again[starts] = 0
    shape = mix(kinds[words.data[words.first]] * U64(16)
                + kinds[words.data[words.end - 1]] * U64(2) + again + U64(1))
    c = constants(6, 17)
    pair, shape2, shape3 = (np.zeros(len(h), U64) for _ in range(3))
    pair[:-1] = mix(h[:-1] * c[0] + h[1:] * c[1])
    shape2[:-1] = mix(shape[:-1] * c[2] + shape[1:] * c[3])
    shape3[:-2] = mix(shape2[:-2] * c[4] + shape[2:] * c[5])
    pair, shape2, shape3, one, single = (
        (x >> _LAST).astype(np.int64) for x in (pair, shape2, shape3, shape, mix(h)))
    seen = np.zeros(1 << BITS, np.int64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        found = np.concatenate([single[a:b], one[a:b], pair[a:b][:max(0, n - 1)],
                                shape2[a:b][:max(0, n - 1)], shape3[a:b][:max(0, n - 2)]])
        at = np.arange(len(found))
        seen[found] = at
        out.append(found[seen[found] == at])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        y, ids = batch.column("y"), batch.column("ids")
        of = np.repeat(np.asarray(y), np.asarray(ids.value_lengths()))
        np.add.at(found, (of, np.asarray(ids.flatten())), 1)
    ids = np.flatnonzero(found.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(found[0, ids]), pa.array(found[1, ids])], ["id", "c0", "c1"])


def log_count_ratios(bags: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of a feature's share among rows of class 1 to that among rows of class 0.

    Counted over ``bags`` (y, ids); at most 2 ** BITS sums reach the driver.
    """
    sums = (bags.select("y", "ids").mapInArrow(_counts, "id long, c0 long, c1 long")
            .groupBy("id").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow())
    counts = np.full((2, 1 << BITS), alpha)
    for y in (0, 1):
        counts[y, sums["id"].to_numpy()] += sums[f"c{y}"].to_numpy()
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            ids = [i.astype(np.int32) for i in _features(part.column("text"))]
            at = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), part.column("y"), part.column("t"), pa.ListArray.from_arrays(
                    pa.array(at, pa.int32()), pa.array(np.concatenate(ids)))],
                ["h", "y", "t", "ids"])


def _descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float,
             epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: one dual variable a row, box [0, cost]."""
    weights, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[ids] for ids in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    # The rarer class gets as much weight in total as the other.
    share = np.array([max(1, (y != s).sum()) / len(y) for s in y])
    order = np.random.default_rng(5)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slack = y[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slack / norms[i], 0.0), 2 * cost * share[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(step) * np.sqrt(norms[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(w[0]), 1e-3) / spread, float(w[1])


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """h, y, t, text: rows of ``docs`` (key, text) with their label, ``max_rows`` at most.

    First the ``max_rows`` labels with the smallest hash of key are taken, then, if keys repeat,
    as many rows with the smallest hash of key, label and text.  Equal rows count once.  Both
    choices combine in each task before one row is sent, so a key of very many rows is no
    harder than others; only hashes are sorted, no texts.
    """
    sample = labels.filter("key is not null and y in (0, 1)").select(
        "key", F.col("y").cast("int").alias("y")).orderBy(
        F.xxhash64("key", "y"), "key", "y").limit(max_rows)
    # At most max_rows rows, here and below.
    joined = docs.select("key", "text").join(F.broadcast(stored(sample.distinct())), "key").select(
        F.xxhash64("key").alias("h"), "y", F.xxhash64("text").alias("t"), "text")
    chosen = joined.select("h", "y", "t").distinct().orderBy(
        F.xxhash64("h", "y", "t"), "h", "y", "t").limit(max_rows)
    return joined.join(F.broadcast(stored(chosen)), ["h", "y", "t"]).dropDuplicates(
        ["h", "y", "t"])


def _bounded(bags: DataFrame, max_features: int) -> DataFrame:
    """Rows of ``bags`` in the order of their hashes, as long as their features fit the bound."""
    order = Window.orderBy("h", "y", "t").rowsBetween(Window.unboundedPreceding, 0)
    # One row of numbers for each of at most max_rows rows.
    fitting = bags.select("h", "y", "t", F.sum(F.size("ids").cast("long")).over(order).alias(
        "total")).filter(F.col("total") <= max_features).drop("total")
    return bags.join(F.broadcast(fitting), ["h", "y", "t"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cost: float = 1.0,
        epochs: int = 20, max_features: int = MAX_FEATURES) -> Model:
    """Fit on ``docs`` (key, text) with ``labels`` (key, y); labels other than 0 and 1 are left out.

    The sample is bounded, as documented: ``max_rows`` rows (see ``labelled_rows``) with
    ``max_features`` features in all; a linear model gains little beyond.  So few labels are sent
    to the texts instead of the texts to them.  Features are taken where the texts are; one task
    fits the machine, on four fifths of the rows, and the curve of the score on the other fifth.
    With no rows the score is 0.5, with rows of one class only that class's smoothed share.
    """
    labelled = labelled_rows(docs, labels, max_rows)
    bags = stored(labelled.mapInArrow(_bags, "h long, y int, t long, ids array<int>"))
    bags = _bounded(bags, max_features)
    scale = log_count_ratios(bags)
    bags = bags.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, h = [], [], []
        for batch in batches:
            flat = np.asarray(batch.column("ids").flatten())
            at = np.asarray(batch.column("ids").offsets)
            at = at - at[0]
            rows += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            y += batch.column("y").to_pylist()
            h += zip(batch.column("h").to_pylist(), batch.column("t").to_pylist(), strict=True)
        if not rows:
            return
        order = sorted(range(len(rows)), key=lambda i: (h[i], y[i]))
        rows, y = [rows[i] for i in order], np.array([2.0 * y[i] - 1 for i in order])
        if len(set(y.tolist())) < 2:
            share = ((y > 0).sum() + 1) / (len(y) + 2)
            result = np.zeros(1 << BITS), 0.0, 1e-3, float(np.log(share / (1 - share)))
        else:
            held = np.arange(len(y)) % 5 == 4
            if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
                held = np.zeros(len(y), bool)
            train = np.flatnonzero(~held)
            weights, bias = _descent([rows[i] for i in train], y[train], scale, cost, epochs)
            weights = weights * scale
            check = np.flatnonzero(held) if held.any() else train
            margin = np.array([weights[rows[i]].sum() for i in check]) + bias
            result = weights, bias, *_logistic(margin, y[check])
        weights = result[0].astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()]), *(pa.array([float(v)]) for v in result[1:])],
            ["weights", "bias", "slope", "offset"])

    rows = bags.mapInArrow(
        run, "weights binary, bias double, slope double, offset double").collect()
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1e-3, 0.0)
    [row] = rows
    return Model(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.offset)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as doc_id, held_out, score in (0, 1) and predicted.

    Every row is scored on its whole text alone; a null, empty or blank text has no feature and
    gets the score of the bias.  Repeated rows get equal scores.  No other column is read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                margin = np.array([model.weights[ids].sum(dtype=np.float64)
                                   for ids in _features(part.column("text"))]) + model.bias
                curve = 1 / (1 + np.exp(-np.clip(
                    margin * model.slope + model.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(curve),
                     pa.array((curve >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key's text, modulo ``by``."""
    return F.crc32(key.cast("string").cast("binary")) % by


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Quality of every document, learned from ``labels`` (doc_id, quality).

    Documents whose crc32(doc_id) mod 5 is 0 are held out: their labels are not learned from.
    A document with several labels counts once for each; one without doc_id cannot be labelled
    and is scored only.  Very long texts are read whole.  Empty tables give an empty result, or,
    without labels, a score of 0.5; further columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = remainder(F.col("doc_id"), 5) == 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held)
    model = fit(docs.withColumnRenamed("doc_id", "key"), known.select(
        F.col("doc_id").alias("key"), F.col("quality").alias("y")))
    return score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model, threshold)
