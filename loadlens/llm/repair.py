"""Repair of the turn structure of conversations by lightest derivations."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.merkle import CRC32_SQL
from loadlens.llm.words import slices
from loadlens.plans.position import with_position
from loadlens.sources.store import stored

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3   # costs of the edits
TRUNCATED = 3                               # and of a truncated row that stays
BLOCK = 256    # rows of a conversation whose edits are found together
GROUP = 32     # blocks, then groups of blocks, that are put together at a time

# What has been said so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (START, ASSISTANT)
# The only role to insert, or to give a row, in each state, and the state it leads to.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
# States in which a row may be kept, by the initial of its role.
_BEFORE = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
# A row as one character: its role's initial (x for others) and whether it must go, is truncated.
_CODES = {chr(97 + 3 * i + j): (initial, fault)
          for i, initial in enumerate("suax") for j, fault in enumerate(("", "truncated", "gone"))}
_SPACES = " \t\n\x0b\x0c\r"

# Edit: place, state before, state behind, cost, audit, rows consumed.
Edit = tuple[int, int, int, int, str, int]


def lightest(edits: Iterable[Edit], length: int, starts: Iterable[int],
             goals: tuple[int, ...] = ()) -> dict[tuple[int, int], tuple[int, str]]:
    """Lightest derivations of (start, state) over all ``length`` places: cost and audit.

    A weighted deduction: the axioms are the edits and, for each start, the empty prefix; a
    prefix that ends at a place in some state and an edit from there give a longer prefix, of
    the sum of the costs and the two audits in a row.  Items leave the agenda by cost, then by
    places covered, then by audit.  No deduction has a smaller value than what it is made of,
    and a smaller part makes a smaller whole, as two audits of one item with the same cost
    never begin with each other; so the first value with which an item leaves is its least.
    With ``goals`` the agenda stops at the first whole prefix that ends in one of them.
    """
    agenda: list[tuple] = [(0, 0, "", start, 0, start, -1) for start in starts]
    agenda += [(cost, 0, audit, place, before, behind, rows)
               for place, before, behind, cost, audit, rows in edits]
    heapq.heapify(agenda)
    ready: dict[tuple[int, int], list] = defaultdict(list)    # edits that left, by where they begin
    waiting: dict[tuple[int, int], list] = defaultdict(list)  # prefixes that left, by their end
    done, found = set(), {}
    while agenda:
        cost, _, audit, *item = heapq.heappop(agenda)
        if item[3] < 0:
            start, place, state, _ = item
            if (start, place, state) in done:
                continue
            done.add((start, place, state))
            if place == length:
                found[start, state] = cost, audit
                if state in goals:
                    return {(start, state): (cost, audit)}
            waiting[place, state].append((start, cost, audit))
            made = [(start, place + rows, behind, cost + c, audit + a)
                    for behind, c, a, rows in ready[place, state]]
        else:
            place, before, behind, rows = item
            ready[place, before].append((behind, cost, audit, rows))
            made = [(start, place + rows, behind, c + cost, a + audit)
                    for start, c, a in waiting[place, before]]
        for start, place, state, c, a in made:
            if (start, place, state) not in done:
                heapq.heappush(agenda, (c, place, a, start, place, state, -1))
    return found


def _edits(codes: str) -> Iterator[Edit]:
    """All single edits of a run of rows, an insertion at any place included."""
    for place, code in enumerate(codes):
        initial, fault = _CODES[code]
        more = TRUNCATED if fault else 0
        for state in _NEXT:
            yield place, state, state, DELETE, "D", 1
            if fault != "gone":
                if state in _BEFORE.get(initial, ()):
                    yield place, state, _AFTER[initial], KEEP + more, "K", 1
                yield place, state, _NEXT[state], REROLE + more, "R", 1
    for place in range(len(codes) + 1):
        for state in _NEXT:
            yield place, state, _NEXT[state], INSERT, "I", 0


@lru_cache(maxsize=4096)
def lightest_repair(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation."""
    (answer,) = lightest(_edits(codes), len(codes), [START], WHOLE).values()
    return answer


def _illegal(codes: str) -> int:
    initials = [_CODES[c][0] for c in codes]
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


_ITEMS = "items array<struct<before: int, behind: int, cost: long, audit: string>>"
_PART = f"key string, block long, blocks long, illegal long, {_ITEMS}"


def _listed(found: dict[tuple[int, int], tuple[int, str]]) -> list[dict]:
    return [{"before": p, "behind": q, "cost": c, "audit": a} for (p, q), (c, a) in found.items()]


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block (key, block, blocks, edge, codes) can do between any two states."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            codes, edge = row["codes"], row.pop("edge")
            if row["blocks"] == 1:
                cost, audit = lightest_repair(codes)
                items = [{"before": START, "behind": START, "cost": cost, "audit": audit}]
            else:
                items = _listed(lightest(_edits(codes), len(codes), list(_NEXT)))
            out.append({"key": row["key"], "block": row["block"], "blocks": row["blocks"],
                        "illegal": _illegal((edge or "") + codes), "items": items})
        yield pa.RecordBatch.from_pylist(out, _arrow_part())


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of neighbouring blocks (key, block, blocks, illegal, parts) as one block each."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            edits = [(place, i["before"], i["behind"], i["cost"], i["audit"], 1)
                     for place, part in enumerate(parts) for i in part["items"]]
            last = row["blocks"] == 1
            found = lightest(edits, len(parts), [START] if last else list(_NEXT),
                             WHOLE if last else ())
            if last:
                found = {(START, START): next(iter(found.values()))}
            out.append({"key": row["key"], "block": row["block"], "blocks": row["blocks"],
                        "illegal": row["illegal"], "items": _listed(found)})
        yield pa.RecordBatch.from_pylist(out, _arrow_part())


def _arrow_part() -> pa.Schema:
    item = pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()),
                      ("audit", pa.string())])
    return pa.schema([("key", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()),
                      ("illegal", pa.int64()), ("items", pa.list_(item))])


def _coded(rows: DataFrame) -> DataFrame:
    """(key, turn, pos, n, fault, code) of each row, in the order of its conversation."""
    shown = F.rtrim(F.col("text"), F.lit(_SPACES))
    narrow = rows.select(
        "key", "turn", "role", "text_hash", F.monotonically_increasing_id().alias("place"),
        F.when(shown == "", "blank").when(
            ~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"))
    placed = stored(with_position(
        stored(narrow), ["turn", "role", "text_hash", "place"], group=["key"], position="pos",
        total="n").drop("place"))
    # A row is a duplicate unless it is the first of its role and text.
    firsts = placed.groupBy("key", "role", "text_hash").agg(F.min("pos").alias("pos")).select(
        "key", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(
        F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(
        F.col("fault") == "truncated", 1).otherwise(0)
    return placed.join(firsts, ["key", "pos"], "left").withColumn("fault", fault).select(
        "key", "turn", "pos", "n", "fault",
        F.substring(F.lit("".join(_CODES)), 3 * kind + gone + 1, F.lit(1)).alias("code"))


def _counted(coded: DataFrame) -> DataFrame:
    """One row for each conversation: gaps and the faults by kind."""
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return coded.groupBy("key").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f)
          for f in ("blank", "duplicate", "truncated")])


def _solved(coded: DataFrame) -> DataFrame:
    """(key, illegal, cost, audit) of each conversation, long ones block by block."""
    block = F.expr(f"pos div {BLOCK}")
    blocks = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    # The last row of a block is also shown to the next one, for the pair across the border.
    shown = F.when((F.col("pos") % BLOCK == BLOCK - 1) & (F.col("pos") + 1 < F.col("n")),
                   F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cells = coded.select("key", "pos", "code", blocks.alias("blocks"), block.alias("own"),
                         F.explode(shown).alias("ahead"))
    runs = cells.groupBy("key", (F.col("own") + F.col("ahead")).alias("block")).agg(
        F.max("blocks").alias("blocks"), F.max(F.when(F.col("ahead") == 1, F.col("code"))).alias(
            "edge"),
        F.array_sort(F.collect_list(F.when(
            F.col("ahead") == 0, F.struct("pos", "code")))).alias("cells"))
    parts = stored(runs.select("key", "block", "blocks", "edge", F.concat_ws("", F.transform(
        "cells", lambda c: c["code"])).alias("codes")).mapInArrow(_solve_blocks, _PART))
    most = parts.agg(F.max("blocks")).head()[0] or 1
    whole = parts.filter("blocks = 1")
    while most > 1:
        near = parts.filter("blocks > 1").groupBy(
            "key", F.expr(f"block div {GROUP}").alias("at")).agg(
            F.expr(f"(max(blocks) + {GROUP - 1}) div {GROUP}").alias("blocks"),
            F.sum("illegal").alias("illegal"),
            F.array_sort(F.collect_list(F.struct("block", "items"))).alias("parts"))
        parts = stored(near.withColumnRenamed("at", "block").mapInArrow(_join_blocks, _PART))
        whole = whole.unionByName(parts.filter("blocks = 1"))
        most = -(-most // GROUP)
    answer = F.get("items", F.lit(0))
    return whole.select("key", "illegal", answer["cost"].alias("cost"),
                        answer["audit"].alias("audit"))


class _Writer:
    """The digest of a repaired conversation, from its audit and its rows as they pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, START, True
        self.digest = hashlib.sha256()

    def _say(self, role: str, text: str, state: int) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first, self.state = False, state

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            state = _NEXT[self.state]
            self._say(_NAMES[state], "", state)

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, text, _AFTER[role[:1]])
        elif edit == "R":
            state = _NEXT[self.state]
            self._say(_NAMES[state], text, state)

    def hexdigest(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256) from sorted rows: a conversation's audit, then its rows."""
    key = writer = None
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        columns = [batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")]
        for own, audit, role, text in zip(*columns, strict=True):
            if audit is not None:
                if writer:
                    out.append({"key": key, "repaired_sha256": writer.hexdigest()})
                key, writer = own, _Writer(audit)
            else:
                writer.row(role, text)
        yield pa.RecordBatch.from_pylist(out, schema)
    if writer:
        yield pa.RecordBatch.from_pylist(
            [{"key": key, "repaired_sha256": writer.hexdigest()}], schema)


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("+"), conv_id.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that depend on conv_id and turn alone.

    Nulls count as one space.  Of twenty rows one is dropped, one emptied, one loses its
    sentence ends, one is repeated and one becomes the user's.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(
        draw == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))))
    return conversations.filter(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: its faults and its cheapest repair.

    ``rows`` has conv_id, turn, role, text.  The result has conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256, for all conv_id of ``conversations`` if
    given, with zeros, an empty audit and the hash of nothing where no row is left.

    Rows are taken by turn, nulls first; rows of one turn by role and text_hash, so equal ones
    are neighbours.  Edits are found by :func:`lightest`, for long conversations in blocks of
    rows and then groups of blocks, between any two states; no task gets the rows of a whole
    conversation, but for the digest of the repaired text: sha256 takes the text in order, so
    the rows of one conversation pass one task, one batch at a time.  A null conv_id is a
    conversation too, null role or text count as one space, a role of another initial can only
    be changed or deleted, very long texts are looked at where they are read, repeated rows are
    duplicates, and an empty table has no rows.  Other columns are ignored, whatever their names.
    """
    texts = rows.select(
        _key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text")).withColumn(
        "text_hash", F.sha2(F.col("text").cast("binary"), 256))
    coded = stored(_coded(texts))
    solved = stored(_solved(coded))
    heads = solved.select("key", "audit", F.lit(0).alias("kind"))
    passing = heads.unionByName(
        texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    hashes = passing.repartition("key").sortWithinPartitions(
        "key", "kind", "turn", "role", "text_hash").select(
        "key", "audit", "role", "text").mapInArrow(_digests, "key string, repaired_sha256 string")
    wanted = (rows if conversations is None else conversations).select("conv_id").distinct()
    whole = wanted.withColumn("key", _key(F.col("conv_id"))).join(
        _counted(coded), "key", "left").join(solved, "key", "left").join(hashes, "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    return whole.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


# Up to two insertions in a row, as a third one never makes anything cheaper.
SQL = f"""WITH RECURSIVE shown AS (
  SELECT coalesce('+' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text, {CRC32_SQL.format(
             "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}
         % 20 AS draw
  FROM conversations),
damaged AS (
  SELECT key, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                   ELSE text END AS text
  FROM (SELECT *, unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) FROM shown WHERE draw <> 0)),
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged),
timed AS (
  SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) AS time,
         lag(left(role, 1)) OVER (PARTITION BY key ORDER BY pos) || left(role, 1) AS pair
  FROM placed),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN time > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated'
                 ELSE '' END AS fault
  FROM timed),
counted AS (
  SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY key),
expected(state, behind) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserted AS (
  SELECT state, '' AS audit, 0 AS cost, state AS behind FROM expected
  UNION ALL SELECT state, 'I', {INSERT}, behind FROM expected
  UNION ALL SELECT a.state, 'II', 2 * {INSERT}, b.behind
  FROM expected a JOIN expected b ON b.state = a.behind),
single(state, initial, op, cost, behind) AS (
  VALUES (0, 's', 'K', {KEEP}, 1), (0, 'u', 'K', {KEEP}, 2), (1, 'u', 'K', {KEEP}, 2),
         (3, 'u', 'K', {KEEP}, 2), (2, 'a', 'K', {KEEP}, 3)
  UNION ALL SELECT state, NULL, 'R', {REROLE}, behind FROM expected
  UNION ALL SELECT state, NULL, 'D', {DELETE}, state FROM expected),
edits AS (
  SELECT i.state, s.initial, s.op, i.audit || s.op AS audit, i.cost + s.cost AS cost, s.behind
  FROM inserted i JOIN single s ON s.state = i.behind),
prefixes AS (
  SELECT key, 0 AS pos, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM counted
  UNION ALL
  SELECT p.key, p.pos + 1, e.behind, min({{
    'cost': p.best.cost + e.cost
            + CASE WHEN e.op <> 'D' AND m.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
    'audit': p.best.audit || e.audit}})
  FROM prefixes p JOIN marked m ON m.key = p.key AND m.pos = p.pos + 1
  JOIN edits e ON e.state = p.state AND (e.initial IS NULL OR e.initial = left(m.role, 1))
    AND (e.op = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.key, p.pos + 1, e.behind),
cheapest AS (
  SELECT p.key, min({{'cost': p.best.cost + i.cost, 'audit': p.best.audit || i.audit}}) AS best
  FROM prefixes p JOIN counted c ON c.key = p.key AND c.n = p.pos
  JOIN inserted i ON i.state = p.state WHERE i.behind IN (0, 3) GROUP BY p.key),
told AS (
  SELECT key, 0 AS step, 0 AS pos, 0 AS state, '' AS said FROM cheapest
  UNION ALL
  SELECT t.key, t.step + 1, t.pos + CASE o.op WHEN 'I' THEN 0 ELSE 1 END,
         CASE WHEN o.op = 'D' THEN t.state WHEN o.op = 'K' AND left(m.role, 1) = 's' THEN 1
              ELSE e.behind END,
         t.said || CASE WHEN o.op = 'D' THEN '' ELSE CASE WHEN t.said = '' THEN '' ELSE chr(10) END
           || CASE WHEN o.op = 'K' THEN m.role WHEN e.behind = 2 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN o.op = 'I' THEN '' ELSE m.text END END
  FROM told t JOIN cheapest c USING (key)
  JOIN LATERAL (SELECT substr(c.best.audit, t.step + 1, 1) AS op) o ON o.op <> ''
  JOIN expected e ON e.state = t.state
  LEFT JOIN marked m ON m.key = t.key AND m.pos = t.pos + 1),
said AS (SELECT key, arg_max(said, step) AS said FROM told GROUP BY key)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(c.best.cost, 0) AS BIGINT) AS cost,
       coalesce(c.best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('+' || conv_id, '') AS key FROM conversations) g
LEFT JOIN counted n USING (key) LEFT JOIN cheapest c USING (key) LEFT JOIN said USING (key)"""
