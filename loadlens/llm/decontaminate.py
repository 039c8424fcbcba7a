"""Benchmark decontamination with SimHash windows and a multi-index Hamming join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.functions.columns import unused
from loadlens.sources.store import stored

SHINGLE = 5
PERCENT = 80
RADIUS = 20   # of 64 bits; two texts at 80 % differ in 10 bits on average, with a deviation of 3
_BITS = 64


def word_list(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingled(words: Column, k: int) -> Column:
    """Struct of the number of words and the hashes of all runs of ``k`` words.

    The words are bound to a lambda variable: as a column they would be worked out anew for
    every run.
    """
    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k),
                           lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.struct(F.size(w).alias("length"), F.when(F.size(w) >= k, runs).otherwise(
            F.array().cast("array<bigint>")).alias("hs"))
    return F.element_at(F.transform(F.array(words), shingles), 1)


def _fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """SimHash by ``keys`` of the hashes h, each counted as often as it occurs, and their number.

    A bit is set if more than half of the hashes have it.  Two bit counts share a long.
    """
    pairs = [F.sum(F.shiftright("h", 2 * j).bitwiseAND(F.lit(1)) + F.shiftleft(
        F.shiftright("h", 2 * j + 1).bitwiseAND(F.lit(1)), 32)).alias(f"s{j}")
        for j in range(_BITS // 2)]
    sums = rows.groupBy(*keys).agg(F.count("h").alias("m"), *pairs)
    value = F.lit(0).cast("long")
    for j in range(_BITS // 2):
        low = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(f"s{j}", 32)
        for count, bit in ((low, 2 * j), (high, 2 * j + 1)):
            value = value.bitwiseOR(F.shiftleft((2 * count > F.col("m")).cast("long"), bit))
    # Written down, as the planner would copy the expression into every block.
    return stored(sums.select(*keys, "m", value.alias("print")))


def _blocks(radius: int) -> Column:
    """(block, value) of a fingerprint cut in radius + 1 blocks: within the radius one is equal."""
    edges = [round(i * _BITS / (radius + 1)) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("print", lo).bitwiseAND(
        F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def _of_width(docs: DataFrame, items: DataFrame, k: int, percent: int, radius: int) -> DataFrame:
    """Matches of items whose shingles have ``k`` words."""
    parts = stored(items.select(
        "item_id", "n", _shingled(F.col("words"), k).alias("s")).select(
        "item_id", "n", F.explode_outer("s.hs").alias("h")))
    known = stored(parts.select("h").distinct())
    sizes = stored(parts.select("h", "n").distinct())
    hashed = docs.select("doc_id", "text_hash", _shingled(word_list("text"), k).alias("s"))
    hits = stored(hashed.select(
        "doc_id", "text_hash", "s.length", F.posexplode_outer("s.hs").alias("at", "h"))
        .join(known, "h").distinct())
    # Hits by window size; a window of n words has n - k + 1 shingles.
    sized = hits.join(sizes, "h").select(
        "doc_id", "text_hash", "n", "length", "at",
        (F.least("n", "length") - k + 1).cast("long").alias("m")).distinct()
    last = F.greatest(F.col("length") - F.col("n"), F.lit(0)).cast("long")
    keys = ["doc_id", "text_hash", "n", "m", "start"]
    # Shifting a window to its first hit keeps all its hits, so the best window begins with a
    # hit or is the last of the text.  Hits within it bound its similarity from above; they are
    # counted by running over hits and window ends together.
    by = Window.partitionBy("doc_id", "text_hash", "n")
    starts = sized.withColumn("i", F.row_number().over(by.orderBy("at"))).filter(
        F.col("at") <= last)
    events = starts.select(
        *keys[:4], F.col("at").cast("long").alias("start"), "i",
        (F.col("at") + F.col("m") - 1).alias("place"), F.lit(0).alias("hit")).unionByName(
        sized.select(*keys[:4], F.lit(None).cast("long").alias("start"), F.lit(0).alias("i"),
                     F.col("at").cast("long").alias("place"), F.lit(1).alias("hit")))
    passed = F.sum("hit").over(by.orderBy("place", F.desc("hit")).rowsBetween(
        Window.unboundedPreceding, 0))
    inner = events.withColumn("passed", passed).filter("hit = 0").select(
        *keys, (F.col("passed") - F.col("i") + 1).alias("hits"))
    final = sized.filter(F.col("at") >= last).withColumn("start", last).groupBy(*keys).agg(
        F.count("*").alias("hits"))
    enough = (100 + percent) * F.col("hits") >= percent * (F.col("m") + F.col("n") - k + 1)
    windows = stored(inner.unionByName(final).filter(enough).select(*keys).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    wanted = windows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    texts = (docs.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
             .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"),
                     _shingled(word_list("text"), k).alias("s"))
             .select("d", "t", F.col("s.hs").alias("hs")))
    inside = stored(windows.join(texts, same).select(
        F.xxhash64("doc_id", "text_hash", "n", "start").alias("window"),
        "doc_id", "text_hash", "n", "start",
        F.explode(F.slice("hs", (F.col("start") + 1).cast("int"), F.col("m").cast("int")))
        .alias("h")))
    keys = ["window", "doc_id", "text_hash", "n", "start"]
    left = _fingerprints(inside, *keys).select(*keys, "m", "print", F.inline(_blocks(radius)))
    right = _fingerprints(parts, "item_id", "n").select(
        "item_id", "n", F.col("m").alias("item_m"), F.col("print").alias("item_print"),
        F.inline(_blocks(radius)))
    pairs = stored(left.join(right, ["n", "block", "value"]).filter(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select(
        *keys, "m", "item_id", "item_m").distinct())
    weights = inside.groupBy("window", "h").agg(F.count("*").alias("c"))
    item_weights = parts.groupBy("item_id", "h").agg(F.count("*").alias("ic"))
    common = (pairs.join(weights, "window").join(item_weights, ["item_id", "h"])
              .groupBy(*keys, "m", "item_id", "item_m").agg(
                  F.sum(F.least("c", "ic")).alias("both")))
    union = F.col("m") + F.col("item_m") - F.col("both")
    return common.filter(100 * F.col("both") >= percent * union).select(
        "doc_id", "text_hash", "item_id", "start", "n",
        (F.col("both") / union).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT,
            radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, start, n, similarity: the best window for each item found.

    Texts are lower-cased runs of letters and digits.  Windows of a document have as many words
    as an item; a document shorter than the item is one window.  Fingerprints are SimHashes of
    the five-word shingles, each with the weight of its number of occurrences (an item of fewer
    words is one shingle).  An index of radius + 1 blocks finds every item of a window's size
    whose fingerprint is within the radius, and the weighted Jaccard similarity of the shingles,
    ``percent`` or more, decides.  Only windows with enough shingles of items of that size to
    reach the similarity are fingerprinted, which loses none.

    Null, empty or wordless texts and items match nothing.  Documents are told apart by doc_id
    and text, so repeated rows give one result and a null doc_id is a value like others.  Items
    with a null item_id are left out; items that share an item_id are compared each by its own
    words, the best is given.  Other columns are not read.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own = benchmark.filter("item_id is not null").select("item_id", word_list("text").alias("words"))
    own = own.distinct().select(
        F.xxhash64("item_id", "words").alias("key"), "item_id", "words",
        F.size("words").alias("n")).filter("n > 0")
    own = stored(own)
    narrow = own.select(F.col("key").alias("item_id"), "n", "words")
    found = None
    for [k] in own.select(F.least("n", F.lit(SHINGLE))).distinct().collect():
        part = _of_width(docs, narrow.filter(F.least("n", F.lit(SHINGLE)) == k), k, percent, radius)
        found = part if found is None else found.unionByName(part)
    names = own.select(F.col("key").alias("k"), F.col("item_id").alias("name"))
    if found is None:
        return docs.limit(0).select(
            "doc_id", "text_hash", F.lit(None).cast("long").alias("item_id"),
            F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"),
            F.lit(0.0).alias("similarity"))
    best = found.join(names, found.item_id == names.k).groupBy(
        "doc_id", "text_hash", F.col("name").alias("item_id")).agg(
        F.max(F.struct("similarity", -F.col("start"), "n")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.col2")).alias("start"),
                       "best.n", "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT,
          radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    own, text_hash = unused(docs.columns, "_id", "_hash")
    found = matches(docs.select("doc_id", "text"), benchmark, percent, radius).select(
        F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(own))
                     & (F.xxhash64("text") == F.col(text_hash)), "left_anti")
