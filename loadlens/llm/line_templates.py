"""Line de-duplication with a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.columns import unused
from loadlens.sources.store import new_folder, scratch, stored

DEPTH = 3         # leading tokens in the path of a leaf, after the token count
MIN_DOCS = 10     # distinct texts in which a template recurs
LIKENESS = 0.5    # least share of fixed tokens in a template
FIELD = "<*>"
# A token with a digit, and blanks between tokens.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"
_BLANKS = r"[\x20\x09-\x0D]+"


def _lines(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def _tokens(line: str) -> Column:
    """Tokens of a line; those with a digit are variable fields.

    Most lines have no digit and single blanks, so the patterns run only where they must.
    """
    bare = F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r"))
    masked = F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, _VARIABLE, FIELD)).otherwise(bare)
    return F.when(masked.rlike(r"[\x09-\x0D]|\x20\x20"), F.split(masked, _BLANKS)).otherwise(
        F.split(masked, " "))


def _parsed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, tokens, leaf and line_hash of every line that is not blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(_lines("text")).alias("line_no", "line"))
    tokens = lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", "text_hash", "line_no", _tokens("line").alias("tokens"))
    return tokens.select("*", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias(
        "leaf"), F.xxhash64("tokens").alias("line_hash"))


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, likeness: float = LIKENESS,
              families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Recurring templates, and the lines that follow them.

    The first table has template, fixed, docs by leaf; the second doc_id, text_hash, line_no and
    template of every line of every row that follows one.

    A line goes down the tree by its number of tokens and its first tokens (with variable fields
    masked).  In a leaf, a token stays fixed at its place if ``min_docs`` lines have it there and
    becomes a field otherwise.  A template recurs if it is found in ``min_docs`` distinct texts
    (copies of a document count once) and at least the share ``likeness`` of its tokens is fixed,
    so prose that merely begins alike is not taken for a template.  With ``families`` (text_hash,
    family; one row per text), all texts of a family count once.
    """
    parsed = _parsed(docs)
    lines = stored(parsed.drop("tokens"))
    seen = lines.select("leaf", "line_hash", "text_hash").distinct()
    if families is not None:
        seen = seen.join(families, "text_hash", "left").select(
            "leaf", "line_hash", F.coalesce("family", "text_hash").alias("text_hash")).distinct()
    seen = stored(seen)
    leaves = (seen.select("leaf", "text_hash").distinct().groupBy("leaf").count()
              .filter(F.col("count") >= min_docs).select("leaf"))
    counts = seen.join(leaves, "leaf", "left_semi").groupBy("leaf", "line_hash").agg(
        F.count("*").alias("n"))
    counts = stored(counts)
    members = (parsed.join(counts.drop("n"), ["leaf", "line_hash"], "left_semi")
               .groupBy("leaf", "line_hash").agg(F.first("tokens").alias("tokens")))
    places = stored(members.join(counts, ["leaf", "line_hash"]).select(
        "leaf", "line_hash", "n", F.posexplode("tokens").alias("place", "token")))
    support = (places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support"))
               .filter((F.col("support") >= min_docs) & (F.col("token") != FIELD)))
    shaped = places.join(support, ["leaf", "place", "token"], "left").withColumn(
        "token", F.when(F.col("support").isNull(), F.lit(FIELD)).otherwise(F.col("token")))
    shaped = shaped.groupBy("leaf", "line_hash").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))),
                                 lambda x: x["token"]), " ").alias("template"),
        F.count("support").alias("fixed"), F.count("*").alias("size"))
    shaped = shaped.filter(F.col("fixed") >= likeness * F.col("size")).select(
        "leaf", "line_hash", "template", "fixed", F.xxhash64("template").alias("shape"))
    shaped = stored(shaped)
    recurring = (seen.join(shaped.drop("template"), ["leaf", "line_hash"])
                 .select("leaf", "shape", "fixed", "text_hash").distinct()
                 .groupBy("leaf", "shape").agg(F.count("*").alias("docs"))
                 .filter(F.col("docs") >= min_docs))
    shaped = stored(shaped.join(recurring, ["leaf", "shape"]))
    found = shaped.groupBy("leaf", "template").agg(
        F.first("fixed").alias("fixed"), F.first("docs").alias("docs"))
    followed = lines.join(shaped, ["leaf", "line_hash"]).select(
        "doc_id", "text_hash", "line_no", "template")
    return found.select("template", "fixed", "docs"), followed


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, likeness: float = LIKENESS,
                         copies: float | None = None,
                         families: DataFrame | None = None) -> DataFrame:
    """``docs`` with text without its recurring lines, and n_lines, n_dropped, n_chars_dropped.

    Every line that follows a recurring template is dropped, in all documents.  With ``copies``,
    a document that would lose more than that share of its characters is taken for a copy of
    other documents rather than a carrier of common lines and is left whole, for near-duplicate
    removal to judge.  ``families`` (text_hash, the xxhash64 of a text, and family) makes near
    copies count as one document instead, so lines that recur only inside them stay.

    All columns of ``docs`` are kept; columns named like the new ones are replaced.  Null and
    empty texts stay as they are, with 0 lines (null) or 1 (empty).  Blank lines are never
    dropped.  Rows are matched by doc_id and text, so rows with a null or repeated doc_id are
    treated each by its own text.
    """
    added = ["n_lines", "n_dropped", "n_chars_dropped"]
    docs = docs.drop(*added)
    own, text_hash, numbers = unused(docs.columns, "_id", "_hash", "_lines")
    path = new_folder(docs.sparkSession)
    with scratch(docs.sparkSession):
        _, followed = templates(docs.select("doc_id", "text"), min_docs, likeness, families)
        dropped = stored(followed.groupBy(
            F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).agg(
            F.array_sort(F.collect_set("line_no")).alias(numbers)), path)
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(own))
                       & (F.xxhash64("text") == F.col(text_hash)), "left")
    lines = _lines("text")
    gone = F.coalesce(numbers, F.array().cast("array<int>"))
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    lost = F.coalesce(F.length("text") - F.length(left), F.lit(0))
    use = F.size(gone) > 0
    if copies is not None:
        use &= lost <= copies * F.length("text")
    kept = [F.when(use, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
            for c in docs.columns]
    return joined.select(
        *kept, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(use, F.size(gone)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
        F.when(use, lost).otherwise(F.lit(0)).cast("long").alias("n_chars_dropped"))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents
), tokens AS (
  SELECT doc_id, text, line_no, list_transform(
    regexp_split_to_array(regexp_replace(line, '^{_BLANKS}|{_BLANKS}$', '', 'g'), '{_BLANKS}'),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS tokens
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), parsed AS (
  SELECT *, struct_pack(n := len(tokens), head := tokens[1:{DEPTH}]) AS leaf FROM tokens
), leaves AS (
  SELECT leaf FROM parsed GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS}
), members AS (
  SELECT leaf, tokens, count(DISTINCT text) AS n
  FROM parsed SEMI JOIN leaves USING (leaf) GROUP BY leaf, tokens
), places AS (
  SELECT leaf, tokens, n, unnest(tokens) AS token, unnest(range(len(tokens))) AS place
  FROM members
), support AS (
  SELECT leaf, place, token FROM places WHERE token <> '{FIELD}'
  GROUP BY leaf, place, token HAVING sum(n) >= {MIN_DOCS}
), shaped AS (
  SELECT p.leaf, p.tokens, list(COALESCE(s.token, '{FIELD}') ORDER BY p.place) AS template
  FROM places p LEFT JOIN support s USING (leaf, place, token)
  GROUP BY p.leaf, p.tokens
  HAVING count(s.token) >= {LIKENESS} * count(*)
), recurring AS (
  SELECT leaf, template FROM parsed JOIN shaped USING (leaf, tokens)
  GROUP BY leaf, template HAVING count(DISTINCT text) >= {MIN_DOCS}
), gone AS (
  SELECT doc_id, text, list(line_no) AS numbers FROM parsed
    JOIN shaped USING (leaf, tokens) JOIN recurring USING (leaf, template)
  GROUP BY doc_id, text
), kept AS (
  SELECT d.doc_id, d.text AS old, string_split(d.text, chr(10)) AS lines,
    COALESCE(g.numbers, []) AS numbers
  FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text
), left_over AS (
  SELECT *, CASE WHEN len(numbers) = 0 THEN old ELSE array_to_string(
    [lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(numbers, i)], chr(10))
    END AS text
  FROM kept
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(COALESCE(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(len(numbers) AS BIGINT) AS n_dropped, CAST(COALESCE(length(old) - length(text), 0)
  AS BIGINT) AS n_chars_dropped, md5(text) AS text_md5
FROM left_over
"""
