"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.functions.columns import unused
from loadlens.llm.graph import components
from loadlens.schemas import quoted
from loadlens.sources.store import new_folder, scratch, stored

HALVES = 8   # collections on either side; HALVES * HALVES tables
ROWS = 2     # minhashes in each half of a table key
# Halves that must agree before two sets outside a common component are compared; sets at 80 %
# agree in 10 of 16 on average and in fewer than 4 once in ten thousand times.
AGREE = 4
LARGE = 64   # rows of a bucket from which its sets are outlined before they are compared
RARE = 64    # sets that have a shingle which is rare among these, at most
PARTS = 64   # parts in which the sets that have a shingle are counted
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "\t\n\v\f\r"


def _shingles(k: int) -> Column:
    """Hashes of the distinct runs of ``k`` words of text; fewer words are one run, none are none.

    A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return; A-Z are lower-cased.  The words are bound to a lambda variable: as a column
    they would be worked out anew for every run.
    """
    words = F.array_remove(F.split(F.translate("text", _UPPER + _BLANKS, _UPPER.lower() + " " * len(
        _BLANKS)), " "), "")

    def runs(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
    found = F.element_at(F.transform(F.array(words), runs), 1)
    return F.array_distinct(F.coalesce(found, F.array().cast("array<long>")))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, times, n_shingles, set_hash (of the whole set) and half keys.

    Rows of one doc_id and text are one row, found ``times`` times.
    """
    sets = docs.select(F.col("doc_id").cast("long"), text_hash(), _shingles(k).alias("shingles"))
    # Named before the set is spread, or they would be worked out anew for every shingle.
    named = sets.withColumns({"n_shingles": F.size("shingles").cast("long"),
                              "set_hash": F.xxhash64(F.array_sort("shingles"))})
    flat = named.select("doc_id", "text_hash", "n_shingles", "set_hash",
                        F.posexplode_outer("shingles").alias("at", "h"))
    # Every minhash has a hash function of its own: the shingle's hash is hashed behind a number.
    least = [F.min(F.xxhash64(F.lit(i), "h")).alias(f"m{i}") for i in range(2 * HALVES * ROWS)]
    met = flat.groupBy("doc_id", "text_hash", "n_shingles", "set_hash").agg(
        F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("times"), *least)
    halves = F.array(*[F.xxhash64(*[f"m{i * ROWS + j}" for j in range(ROWS)])
                       for i in range(2 * HALVES)])
    return met.select("doc_id", "text_hash", "times", "n_shingles", "set_hash", F.when(
        F.col("n_shingles") > 0, halves).otherwise(F.array().cast("array<long>")).alias("halves"))


def text_hash() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64("text").alias("text_hash")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_hash and the distinct shingles of each row of ``docs`` (text, set_hash)."""
    return docs.select(F.col("set_hash").alias("id"), _shingles(k).alias("shingles"))


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, slot, id, n, rank, low, na): all sets of the buckets of all tables but the first.

    Table (i, j) is keyed by half i of the first collection and half j of the second, so
    HALVES**2 tables need only 2 * HALVES halves.  ``low`` is the first set of the bucket, of
    ``na`` shingles; ``rank`` counts from it.
    """
    first = classes.select("id", "n", F.posexplode(F.slice("halves", 1, HALVES)).alias("i", "x"),
                           "halves")
    keys = first.select("id", "n", "i", "x", F.posexplode(
        F.slice("halves", HALVES + 1, HALVES)).alias("j", "y")).select(
        F.xxhash64("i", "j", "x", "y").alias("key"),
        (F.col("i") * HALVES + F.col("j")).alias("slot"), "id", "n")
    by = Window.partitionBy("key").orderBy("id")
    return keys.select("*", F.row_number().over(by).alias("rank"), F.first("id").over(by).alias(
        "low"), F.first("n").over(by).alias("na")).filter("rank > 1")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, compared whole, reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").filter(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _alike(x: str, y: str) -> Column:
    """Whether two sets agree in AGREE halves at least, as sets at 80 % nearly always do."""
    same = F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda s: s)
    return F.size(same) >= AGREE


def _first_slot(x: str, y: str) -> Column:
    """The first table in which two sets share a bucket."""
    def first(start: int) -> Column:
        same = F.zip_with(F.slice(x, start, HALVES), F.slice(y, start, HALVES),
                          lambda p, q: p == q)
        return F.array_position(same, True) - 1
    return first(1) * HALVES + first(HALVES + 1)


def _classes(filled: DataFrame) -> DataFrame:
    """A row for each set: id, n, halves, its first doc_id, number of rows and one of them.

    A row is found by doc_id and text, as a doc_id may have several texts.
    """
    return filled.groupBy(F.col("set_hash").alias("id")).agg(
        F.first("n_shingles").alias("n"), F.first("halves").alias("halves"),
        F.min("doc_id").alias("first"), F.sum("times").alias("rows"),
        F.min(F.struct("text_hash", "doc_id")).alias("row"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id) with the component of their set so far."""
    return rows.join(labels, F.col("id") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "id")).drop("node")


def _outlines(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``rest`` with common and rare, by which the sets of a large bucket are told apart.

    Of a set in a bucket of more than LARGE rows, ``rare`` are the shingles that 2 to RARE of
    these sets have, and ``common`` is the number of those that more have; what is in no other
    such set is in neither.  In smaller buckets all shingles count as common.
    """
    large = rest.groupBy("key").count().filter(F.col("count") > LARGE).select(
        "key", F.lit(True).alias("large"))
    rows = stored(rest.join(large, "key", "left"))
    ids = rows.filter("large").select("id").distinct()
    own = stored(sets.join(ids, "id", "left_semi").select(
        "id", F.explode("shingles").alias("shingle")))
    # Counted in parts, which keep the sets while they are few, so no group holds a large one.
    parts = own.groupBy("shingle", F.pmod("id", F.lit(PARTS)).alias("part")).agg(
        F.collect_list("id").alias("ids")).select(
        "shingle", F.size("ids").alias("n"), F.when(F.size("ids") <= RARE, F.col("ids")).alias("ids"))
    holders = parts.groupBy("shingle").agg(
        F.sum("n").alias("times"), F.flatten(F.collect_list("ids")).alias("ids"))
    few = holders.filter(F.col("times") <= RARE).select(
        "shingle", "times", F.explode("ids").alias("id"))
    few = few.groupBy("id").agg(F.count(F.lit(1)).alias("few"), F.collect_list(
        F.when(F.col("times") > 1, F.col("shingle"))).alias("rare"))
    # Only a row in a large bucket has an outline, so both sets of a pair have one or neither.
    few = few.withColumn("large", F.lit(True))
    return rows.join(few, ["id", "large"], "left").select(
        *rest.columns, (F.col("n") - F.coalesce("few", F.lit(0))).alias("common"),
        F.coalesce("rare", F.array().cast("array<long>")).alias("rare"))


def _within_reach(percent: int) -> Column:
    """Whether the sets of two outlines can be similar: what they have in common is bounded."""
    def enough(most: Column) -> Column:
        return 100 * most >= percent * (F.col("n") + F.col("na") - most)
    common = F.least("common", "common_a")
    return (enough(F.least(F.col("common") + F.size("rare"), F.col("common_a") + F.size("rare_a")))
            & enough(common + F.size(F.array_intersect("rare", "rare_a"))))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (key, component) of buckets whose rows are of more than one component."""
    of = Window.partitionBy("key")
    return rows.select("*", F.min("component").over(of).alias("least"), F.max("component").over(
        of).alias("most")).filter("least < most").drop("least", "most")


def connected(docs: DataFrame, classes: DataFrame, k: int, percent: int,
              native: bool = False) -> DataFrame:
    """(node, component) of the sets with links; all that share a bucket and agree are connected.

    In each bucket the first set is compared with the others.  The others need no more than to be
    connected with one another, wherever the first is: where they are in several components, the
    next four are compared with those further on that are in other components by then, then the
    next 64, and so on until the rest of the bucket is one component.  A pair is compared only
    in the first bucket it shares, and in a large bucket only if what the two can have in common
    at most would do (``_outlines``).  Near copies of one text are thus done after a few
    comparisons for each, and every pair of a bucket is compared, connected or too far apart.
    """
    buckets = stored(_buckets(classes))
    members = buckets.select("id").union(buckets.select("low")).distinct()
    texts = classes.join(members, "id", "left_semi").select(
        F.col("id").alias("set_hash"), F.col("row.text_hash").alias("own"),
        F.col("row.doc_id").alias("name"))
    sets = stored(shingle_sets(docs.select("doc_id", "text", text_hash()).join(
        texts, (F.col("text_hash") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("name")))
        .select("set_hash", "text").dropDuplicates(["set_hash"]), k))
    close = 100 * F.least("na", "n") >= percent * F.greatest("na", "n")
    pairs = buckets.filter(close).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(_verified(pairs, sets, percent), native)
    own = classes.select("id", "halves")
    rest = stored(_apart(_labelled(buckets.drop("low", "na"), labels)))
    rest = stored(_outlines(rest, sets).join(own, "id"))
    done, step = 1, 4
    while rest.limit(1).count():
        few = rest.filter(F.col("rank") <= done + step).select(
            "key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("halves").alias("ha"),
            F.col("rank").alias("ra"), F.col("component").alias("ca"),
            F.col("common").alias("common_a"), F.col("rare").alias("rare_a"))
        pairs = rest.join(few, (rest.key == few.key) & (F.col("rank") > F.col("ra"))
                          & (F.col("component") != F.col("ca")) & close & _alike("halves", "ha")
                          & (_first_slot("halves", "ha") == F.col("slot"))
                          & _within_reach(percent))
        found = _verified(pairs.select("a", F.col("id").alias("b")).distinct(), sets, percent)
        labels = components(found.union(labels.select("component", "node")), native)
        done, step = done + step, 16 * step
        rest = stored(_apart(_labelled(
            rest.filter(F.col("rank") > done).drop("component"), labels)))
    return labels


def _roots(docs: DataFrame, filled: DataFrame, k: int, percent: int,
           native: bool = False) -> DataFrame:
    """(set_hash, first, root) of the sets of ``filled`` that have copies or links."""
    spark = docs.sparkSession
    path = new_folder(spark)
    with scratch(spark):
        classes = stored(_classes(filled))
        label = connected(docs, classes, k, percent, native)
        return stored(classes.join(label, F.col("id") == F.col("node"), "left").filter(
            "node is not null or rows > 1").select(
            F.col("id").alias("set_hash"), "first", F.coalesce("component", "id").alias("root")),
            path)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80,
                    native: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of documents with similar shingle sets.

    Two documents are linked when the Jaccard similarity of their sets of ``k``-word shingles is
    ``percent`` or more; component_id is the smallest doc_id reachable over links.  Minhashes
    propose pairs (a pair at 80 % is missed about once in 1,500 times), whole sets confirm them.

    Equal sets are one node, so copies are never compared.  A null, empty or blank text has no
    shingle and is linked with nothing.  Rows that repeat a doc_id are each returned, with the
    class of their own text.  A row without doc_id is returned with a null component and kept,
    as there is no name under which it could be dropped.  Other columns are ignored.  With
    ``native`` links are joined up by DataFrame operations alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, k))
    filled = signed.filter("doc_id is not null and n_shingles > 0")
    # The first document of a class of equal sets, then of the component of such classes.
    classes = _roots(docs, filled, k, percent, native)
    firsts = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = classes.select("set_hash", "root").join(firsts, "root").select(
        F.col("set_hash").alias("node"), "first")
    own = signed.join(named, F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_hash"))
        == F.col("node"), "left").withColumn(
        "time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    component = F.coalesce("first", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class of near copies, and all rows like no other.

    The row with the smallest doc_id stays; rows without doc_id come last, rows of one doc_id
    are taken by the hash of all their columns, and of equal rows one stays.  A null, empty or
    blank text is like no other.  All columns are kept, whatever their names; very long texts
    are compared whole, and an empty table stays empty.
    """
    own, root, none, name, row, best_row = unused(
        docs.columns, "own", "root", "none", "name", "row", "best")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = docs.withColumn(row, F.xxhash64(*[F.col(quoted(c)) for c in docs.columns]))
    path = new_folder(docs.sparkSession)
    with scratch(docs.sparkSession):
        signed = stored(signatures(texts, k))
        filled = signed.filter("n_shingles > 0")
        classes = _roots(texts, filled, k, percent).select("set_hash", "root")
        # One row for each text that is in a class, so a text with many copies is one row.
        members = stored(signed.select("text_hash", "set_hash").distinct().join(
            classes, "set_hash").select(F.col("text_hash").alias(own), F.col("root").alias(root)))
        narrow = marked.select(
            F.xxhash64("text").alias("text_hash"), F.col("doc_id").isNull().alias(none),
            F.col("doc_id").cast("long").alias(name), row)
        met = stored(narrow.join(members, F.col("text_hash") == F.col(own)))
        best = met.groupBy(root).agg(F.min(F.struct(none, name, row)).alias(best_row))
        # The rows of classes are told by their hash, so copies of one text are spread.
        met = stored(met.join(best, root).groupBy(F.col(row).alias(own)).agg(F.max(
            F.struct(none, name, row) == F.col(best_row)).alias(best_row)), path)
    turn = F.row_number().over(Window.partitionBy(row).orderBy(row))
    left = marked.join(met, F.col(row) == F.col(own), "left").withColumn(name, turn)
    return left.filter(F.col(best_row).isNull() | (F.col(best_row) & (F.col(name) == 1))).select(
        *[quoted(c) for c in docs.columns])
