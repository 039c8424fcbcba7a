"""Merkle manifest of a dataset: hash trees by source, inclusion proofs, tampered rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.plans.position import with_position
from loadlens.sources.store import stored

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of the UTF-8 bytes of ``text``."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def without_line_feeds(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where crc32 of the decimal doc_id is even, else as it is."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def source_key(source: Column) -> Column:
    """A name of the source that is never null; the null source's comes first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source))


def _slot(i: int) -> Column:
    """The child in place ``i`` of its run; null where the run is shorter."""
    return F.max(F.when(F.col("pos") % FANOUT == i, F.col("node")))


def _level_above(level: DataFrame) -> DataFrame:
    """One row for each run of children: the children in FANOUT columns, and their hash.

    ``level`` has (tree, pos, n, node), n being the number of nodes of its tree at this level.
    """
    slots = [f"c{i}" for i in range(FANOUT)]
    runs = level.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("run")).agg(
        F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"),
        *[_slot(i).alias(c) for i, c in enumerate(slots)]).withColumnRenamed("run", "pos")
    return runs.select("tree", "pos", "n", *slots, digest(F.concat_ws("", *slots)).alias("node"))


def _siblings(own: Column) -> Column:
    """What stands before and behind the own slot among the children's columns."""
    def beside(there: Callable[[int], Column]) -> Column:
        return F.concat_ws("", *[F.when(there(i), F.col(f"c{i}")) for i in range(FANOUT)])
    return F.struct(beside(lambda i: F.lit(i) < own).alias("before"),
                    beside(lambda i: F.lit(i) > own).alias("behind"))


def _heights(leaves: DataFrame) -> list[DataFrame]:
    """All levels from the leaves up; a tree has no row in the levels above its root."""
    levels, most = [leaves], leaves.agg(F.max("n")).head()[0] or 1
    while most > 1:
        levels.append(stored(_level_above(levels[-1].filter("n > 1"))))
        most = -(-most // FANOUT)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path`` and ``subroot``; ``tops`` has (tree, path) of the trees' roots.

    ``path`` lists the siblings from the leaf to the top.  It is handed down level by level, so
    each join has as many rows as the level has nodes.
    """
    beyond = None
    for level in reversed(levels):
        mine = [c for c in level.columns if c not in ("tree", "pos", "n")]
        here = level.filter("n = 1").join(tops, "tree").select(
            "tree", "pos", *mine, "path", F.col("node").alias("subroot"))
        if beyond is not None:
            parents = beyond.select("tree", F.col("pos").alias("parent"), "path", "subroot",
                                    *[F.col(f"c{i}") for i in range(FANOUT)])
            below = level.filter("n > 1").select(
                "tree", "pos", F.expr(f"pos div {FANOUT}").alias("parent"),
                F.struct(*mine).alias("mine"))
            path = F.concat(F.array(_siblings(F.col("pos") % FANOUT)), F.col("path"))
            here = here.unionByName(below.join(parents, ["tree", "parent"]).select(
                "tree", "pos", *[F.col("mine")[c].alias(c) for c in mine],
                path.alias("path"), "subroot"))
        beyond = here
    return beyond


def _folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and its siblings."""
    return F.aggregate(path, node, lambda inner, at: digest(
        F.concat(at["before"], inner, at["behind"])))


def _proof(path: Column) -> Column:
    return digest(F.concat_ws("", F.transform(path, lambda at: F.concat(
        at["before"], at["behind"]))))


def manifest(docs: DataFrame, tamper: Callable[[Column, Column], Column] = without_line_feeds
             ) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified of each document.

    A row's leaf is the hash of FIELDS.  By source, leaves ascend by doc_id (nulls first), and
    every FANOUT consecutive nodes become their hash until one is left, the subroot; subroots in
    the order of their sources (null first, bytewise) give the root in the same way.  ``path``
    has the siblings from the leaf to the root, before and behind the own place.  folded_root is
    worked out from the tampered row's leaf and the original siblings.

    Positions come from range partitioning, so a source with most of the rows spreads over
    tasks.  Rows that share a source and a doc_id are ordered by leaf; equal rows are told apart
    by their place in the input, which changes none of the results.  Null and empty fields have
    leaves of their own, very long texts are hashed where they are read and go no further, and
    an empty table has no rows.  Columns other than FIELDS are ignored, whatever their names.
    """
    tampered = tamper(F.col("doc_id"), F.col("text"))
    original, changed = leaf_digest(*map(F.col, FIELDS)), leaf_digest(
        *[tampered if c == "text" else F.col(c) for c in FIELDS])
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("tree"),
        original.alias("node"),
        F.when(~tampered.eqNullSafe(F.col("text")), changed).alias("changed"),
        F.monotonically_increasing_id().alias("place")))
    leaves = stored(with_position(
        rows, ["doc_id", "node", "place"], group=["tree"], position="pos", total="n"
    ).drop("place"))
    levels = _heights(leaves)
    subroots = reduce(DataFrame.unionByName, [
        level.filter("n = 1").select("tree", "node") for level in levels])
    # The same again over the subroots, as the leaves of one tree.
    sources = stored(with_position(subroots, ["tree"], position="pos", total="n"))
    upper = _heights(sources.select(
        F.lit("").alias("tree"), "pos", "n", "node", F.col("tree").alias("source")))
    found = upper[-1].filter("n = 1").select("node").head()
    root = F.lit(found.node if found else None).cast("string")
    empty = F.expr("cast(array() as array<struct<before: string, behind: string>>)")
    over = _paths(upper, docs.sparkSession.range(1).select(
        F.lit("").alias("tree"), empty.alias("path")))
    tops = stored(over.select(F.col("source").alias("tree"), "path"))
    return _paths(levels, tops).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), "path",
        _proof(F.col("path")).alias("proof_sha256"),
        _folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


# The unsigned crc32 of the characters of {0}, all ASCII; -1 stands for a shift by one bit.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT)
               ELSE a // 2 END), 4294967295::BIGINT)"""


def _sql_leaf(text: str) -> str:
    fields = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """``name``_nodes: all nodes of the trees over ``leaves``; ``name``_sides: their siblings."""
    return f"""{name}_nodes AS (
  SELECT 0 AS level, tree, pos, n, node FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, pos // 3, (any_value(n) + 2) // 3,
         sha256(string_agg(node, '' ORDER BY pos))
  FROM {name}_nodes WHERE n > 1 GROUP BY level, tree, pos // 3),
{name}_sides AS (
  SELECT a.level, a.tree, a.pos,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
  FROM {name}_nodes a JOIN {name}_nodes b
    ON a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.level, a.tree, a.pos)"""


def _sql_walk(name: str, start: str, tree: str) -> str:
    """``name``: the ways up ``tree`` from the rows of ``start``; ``name``_end: at the top."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.id, w.level + 1, w.tree, w.pos // 3, w.proof || s.before || s.behind,
         sha256(s.before || w.fold || s.behind)
  FROM {name} w JOIN {tree}_sides s ON w.level = s.level AND w.tree = s.tree AND w.pos = s.pos),
{name}_end AS (SELECT w.* FROM {name} w JOIN {tree}_nodes t
  ON w.level = t.level AND w.tree = t.tree AND w.pos = t.pos AND t.n = 1)"""


_INSIDE = "SELECT id, 0 AS level, tree, pos, '' AS proof, changed AS fold FROM leaves"
_OUTSIDE = """SELECT i.id, 0 AS level, s.tree, s.pos, i.proof, i.fold
  FROM inside_end i JOIN sources s ON i.tree = s.source"""

SQL = f"""WITH RECURSIVE given AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree,
         {_sql_leaf("text")} AS node,
         CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 2 = 0
              THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, node) AS id,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM given),
{_sql_tree("lower", "leaves")},
sources AS (
  SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos,
         count(*) OVER () AS n, node FROM lower_nodes WHERE n = 1),
{_sql_tree("upper", "sources")},
{_sql_walk("inside", _INSIDE, "lower")},
{_sql_walk("outside", _OUTSIDE, "upper")}
SELECT l.doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, sha256(o.proof) AS proof_sha256,
       o.fold AS folded_root, o.fold = r.node AS verified
FROM leaves l JOIN outside_end o USING (id) JOIN sources s ON s.source = l.tree
JOIN (SELECT node FROM upper_nodes WHERE n = 1) r ON true"""
