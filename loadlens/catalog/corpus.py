"""Queries of chat corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.catalog import Query
from loadlens.catalog import tables as t
from loadlens.operators import corpus

_LENGTH = 64
_WORDS = 1000


def _conversations(spark, sf):
    return corpus.collect_conversations(t.turns(spark, sf))


def collect_conversations(spark, sf):
    return _conversations(spark, sf).select(
        "conv_id", F.to_json("conversations").alias("conversations"))


def _messages(spark, sf):
    # The operator drops every other column, so the key rides in a second select.
    chats = _conversations(spark, sf)
    return chats.select("conv_id", F.transform("conversations", lambda m: F.struct(
        corpus.chat_role(m["from"]).alias("role"), m["value"].alias("content"))).alias("messages"))


def to_chat_messages(spark, sf):
    return corpus.to_chat_messages(_conversations(spark, sf)).select(
        F.to_json("messages").alias("messages"))


def render_chat(spark, sf):
    return corpus.render_chat(_messages(spark, sf)).select("conv_id", "prompt")


def _padded(spark, sf):
    tokens = corpus.tokenise(
        corpus.render_chat(_messages(spark, sf)), corpus.whitespace_tokens(_WORDS))
    return corpus.with_labels(corpus.pad_truncate(tokens, _LENGTH), mask_pads=True)


def _listed(df, *cols):
    return df.select("conv_id", *[
        F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in cols])


def tokenise(spark, sf):
    tokens = corpus.tokenise(
        corpus.render_chat(_messages(spark, sf)), corpus.whitespace_tokens(_WORDS))
    return _listed(tokens, "input_ids")


def pad_truncate(spark, sf):
    return _listed(_padded(spark, sf), "input_ids", "attention_mask")


def with_labels(spark, sf):
    return _listed(_padded(spark, sf), "labels")


def _split(spark, sf, exact):
    documents = t.table(spark, sf, "documents").select("doc_id")
    return corpus.split_train_test(documents, "doc_id", exact=exact)


def split_train_test(spark, sf):
    return _split(spark, sf, False)


def split_train_test_exact(spark, sf):
    return _split(spark, sf, True)


_CHAT_SQL = """
chats AS (
  SELECT conv_id,
    list(struct_pack("from" := CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt'
                                     ELSE role END, value := text) ORDER BY turn) AS conversations,
    list(struct_pack(role := CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END,
                     content := text) ORDER BY turn) AS messages,
    string_agg('<|' || CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END || '|>' || chr(10)
               || text, chr(10) ORDER BY turn) AS prompt
  FROM conversations GROUP BY conv_id)"""

_TOKENS_SQL = _CHAT_SQL + f""",
tokens AS (
  SELECT conv_id, list_transform(
    list_filter(string_split_regex(prompt, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''),
    lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {_WORDS}) AS ids
  FROM chats),
padded AS (
  SELECT conv_id, least(len(ids), {_LENGTH}) AS n,
         list_resize(ids[1:{_LENGTH}], {_LENGTH}, 0) AS input_ids FROM tokens)"""

_POSITIONS = f"range({_LENGTH})"

QUERIES = {
    "collect_conversations": Query(collect_conversations, f"""WITH {_CHAT_SQL}
SELECT conv_id, CAST(to_json(conversations) AS VARCHAR) AS conversations FROM chats"""),
    "to_chat_messages": Query(to_chat_messages, f"""WITH {_CHAT_SQL}
SELECT CAST(to_json(messages) AS VARCHAR) AS messages FROM chats"""),
    "render_chat": Query(render_chat, f"WITH {_CHAT_SQL} SELECT conv_id, prompt FROM chats"),
    "tokenise": Query(tokenise, f"""WITH {_TOKENS_SQL}
SELECT conv_id, array_to_string(ids, ' ') AS input_ids FROM tokens"""),
    "pad_truncate": Query(pad_truncate, f"""WITH {_TOKENS_SQL}
SELECT conv_id, array_to_string(input_ids, ' ') AS input_ids,
       array_to_string(list_transform({_POSITIONS}, lambda i: CASE WHEN i < n THEN 1 ELSE 0 END),
                       ' ') AS attention_mask FROM padded"""),
    "with_labels": Query(with_labels, f"""WITH {_TOKENS_SQL}
SELECT conv_id, array_to_string(list_transform({_POSITIONS},
       lambda i: CASE WHEN i < n THEN input_ids[i + 1] ELSE -100 END), ' ') AS labels
FROM padded"""),
    "split_train_test": Query(split_train_test, """
SELECT doc_id, CASE WHEN substr(md5('42:' || doc_id), 1, 8) < '19999999'
       THEN 'test' ELSE 'train' END AS split FROM documents"""),
    "split_train_test_exact": Query(split_train_test_exact, """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
       <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents"""),
}
