"""Chat corpus preparation: roles, split, rendering, tokens, padding, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.hashing import seeded_hash, token_id

# Role names.
HUMAN, USER, ASSISTANT = "human", "user", "assistant"

# Fixed value: label of positions the loss leaves out.
IGNORED = -100

_HEX_DIGITS = 4


def chat_role(speaker: Column) -> Column:
    """``human`` is the user, anyone else the assistant."""
    return F.when(speaker == HUMAN, F.lit(USER)).otherwise(F.lit(ASSISTANT))


def to_chat_messages(df: DataFrame) -> DataFrame:
    """Conversations as messages with role and content, in order; other columns go."""
    return df.select(F.transform("conversations", lambda t: F.struct(
        chat_role(t["from"]).alias("role"), t["value"].alias("content"))).alias("messages"))


def collect_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", speaker: str = "from",
    text: str = "value",
) -> DataFrame:
    """One-row-per-turn input as ``conversations`` arrays in turn order.

    Turn numbers are unique within a conversation.  A conversation is one row, however long: it
    is rendered and tokenised as one text.
    """
    ordered = F.array_sort(F.collect_list(F.struct(turn, speaker, text)))
    return turns.groupBy(key).agg(
        F.transform(ordered, lambda t: F.struct(
            t[speaker].alias("from"), t[text].alias("value"))).alias("conversations"))


def split_train_test(
    df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add ``split``, train or test, by a seeded hash of the unique ``key``.

    The split of a row does not depend on partitioning.  By default the test share
    is approximate and needs no shuffle.  ``exact`` takes the ceil(rows * ratio)
    rows smallest by hash, ties by key: rows are counted per hash prefix, the hash at the
    boundary is looked up in the one prefix it falls into, and all rows are compared with it.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(key), seed))
    if not exact:
        # Above every prefix for a ratio of 1, as g sorts behind the hexadecimal digits.
        limit = f"{int(ratio * 16**8):08x}" if ratio < 1 else "g"
        in_test = F.substring("_hash", 1, 8) < limit
        return hashed.withColumn(
            "split", F.when(in_test, "test").otherwise("train")).drop("_hash")
    prefix = F.substring("_hash", 1, _HEX_DIGITS)
    # At most 16 ** _HEX_DIGITS rows, whatever the input.
    counts = hashed.groupBy(prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    need = (F.ceil(F.lit(float(ratio)) * F.sum("_rows").over(everything))
            - F.sum("_rows").over(running) + F.col("_rows"))
    edge = counts.withColumn("_need", need).filter(
        (F.col("_need") > 0) & (F.col("_need") <= F.col("_rows"))).select("_prefix", "_need").head()
    if edge is None:
        return hashed.withColumn("split", F.lit("train")).drop("_hash")
    last = hashed.filter(prefix == edge["_prefix"]).select("_hash", key).orderBy(
        "_hash", key).offset(edge["_need"] - 1).head()
    in_test = (F.col("_hash") < last["_hash"]) | (
        (F.col("_hash") == last["_hash"]) & (F.col(key) <= F.lit(last[key])))
    return hashed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_hash")


def role_tags(message: Column) -> Column:
    """Default template of one message: a role tag line, then the content."""
    return F.concat(F.lit("<|"), message["role"], F.lit("|>\n"), message["content"])


def render_chat(
    df: DataFrame, template: Callable[[Column], Column] = role_tags, sep: str = "\n"
) -> DataFrame:
    """Add ``prompt``: the messages rendered to one string, without a generation prompt."""
    return df.withColumn("prompt", F.array_join(F.transform("messages", template), sep))


def whitespace_tokens(vocabulary: int = 32_000) -> Callable[[Column], Column]:
    """Default tokenizer: ids of the whitespace-separated words in a hashed vocabulary."""
    def ids(text: Column) -> Column:
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        return F.transform(words, lambda w: token_id(w, vocabulary))
    return ids


def tokenise(df: DataFrame, tokenizer: Callable[[Column], Column] | None = None,
             text: str = "prompt") -> DataFrame:
    """Add ``input_ids``.  ``tokenizer`` is an expression or a pandas UDF over the text."""
    return df.withColumn("input_ids", (tokenizer or whitespace_tokens())(F.col(text)))


def pad_truncate(
    df: DataFrame, n: int = 512, pad_id: int = 0, side: str = "right"
) -> DataFrame:
    """Cut or pad ``input_ids`` to ``n`` and add ``attention_mask``."""
    kept = F.slice("input_ids", 1, n)
    missing = F.lit(n) - F.size(kept)
    padding = F.array_repeat(F.lit(pad_id), missing)
    ones, zeros = F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), missing)
    if side == "right":
        ids, mask = F.concat(kept, padding), F.concat(ones, zeros)
    else:
        ids, mask = F.concat(padding, kept), F.concat(zeros, ones)
    return df.withColumns({"input_ids": ids, "attention_mask": mask})


def with_labels(df: DataFrame, mask_pads: bool = False) -> DataFrame:
    """Add ``labels``, a copy of the ids; ``mask_pads`` marks padding as ignored."""
    if not mask_pads:
        return df.withColumn("labels", F.col("input_ids"))
    return df.withColumn("labels", F.zip_with(
        "input_ids", "attention_mask",
        lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED))))
