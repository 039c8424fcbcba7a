"""Text expressions: trimming, escaping, answer extraction and answer comparison."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_OTHER_DIGITS = "".join(
    chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
_THEIR_VALUES = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)

# Marker before the final answer, replies that are not numbers, default answer.
ANSWER_MARKER = "####"
NO_NUMBER = "NONE"
FAILED = "ERROR"
NO_ANSWER = "NO_ANSWER_FOUND"

# Fixed value: a whole or decimal number standing alone.
REPLY_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"


def strip(col: Column) -> Column:
    """Trim every Unicode whitespace character (``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def final_answer(col: Column) -> Column:
    """Text after the last answer marker, trimmed; the whole text without a marker."""
    return strip(F.element_at(F.split(col, ANSWER_MARKER), -1))


def json_escape(col: Column) -> Column:
    """Make text safe inside a JSON string; text without special characters is unchanged."""
    escaped = col
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\r", " "), ("\n", " ")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return F.when(col.rlike(r'["\\\r\n]'), strip(escaped)).otherwise(col)


def pipe_escape(col: Column) -> Column:
    """Backslash before pipe, backslash and quote, for an unquoted pipe-delimited file."""
    return F.regexp_replace(col, r'([|\\"])', r"\\$1")


def extract_json(col: Column, paths: tuple[str, ...] = ("$.response",),
                 default: str | None = NO_ANSWER) -> Column:
    """First of ``paths`` found in a JSON document, else ``default``."""
    found = [F.get_json_object(col, p) for p in paths]
    return F.coalesce(*found, F.lit(default))


def reply_text(col: Column) -> Column:
    """Text of a model reply: ``response`` unless empty, else the first choice's text."""
    response = F.nullif(F.get_json_object(col, "$.response"), F.lit(""))
    choice = F.get_json_object(col, "$.choices[0].text")
    unusable = F.get_json_object(col, "$").isNull() | (
        response.isNull() & (F.get_json_object(col, "$.choices") == "[]")
    )
    return F.when(unusable, F.lit(FAILED)).otherwise(
        strip(F.coalesce(response, choice, F.lit("")))
    )


def parse_reply(col: Column) -> Column:
    """The first stand-alone number of a reply, NONE for a reply of none, else the reply."""
    text = strip(col)
    number = F.nullif(F.regexp_extract(text, REPLY_NUMBER, 0), F.lit(""))
    return F.when(F.upper(text) == NO_NUMBER, F.lit(NO_NUMBER)).otherwise(
        F.coalesce(number, text)
    )


def last_number(col: Column) -> Column:
    """Default extractor: the last number of the text without thousands commas, else NONE."""
    numbers = F.regexp_extract_all(col, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    last = F.try_element_at(numbers, F.lit(-1))
    return F.coalesce(F.replace(last, F.lit(","), F.lit("")), F.lit(NO_NUMBER))


def answer_key(col: Column) -> Column:
    """Comparison key of an answer as struct(kind, num, text).

    Kind ``i`` holds an integer as digits without leading zeros, ``f`` a decimal
    number, ``s`` text that is neither.  Keys of different kinds are never equal,
    so ``18`` and ``18.0`` differ.  Signs and separators are dropped first.
    """
    digits = F.regexp_replace(
        F.translate(col, _OTHER_DIGITS, _THEIR_VALUES), r"[^0-9.]", ""
    )
    is_word = (col == "") | col.isin(FAILED, NO_NUMBER)
    is_float = digits.rlike(r"^(?:[0-9]+\.[0-9]*|\.[0-9]+)$")
    is_int = digits.rlike(r"^[0-9]+$")

    def key(kind: str, num: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(None) if num is None else num).cast("double").alias("num"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    return (
        F.when(is_word, key("s", text=col))
        .when(is_float, key("f", num=digits.try_cast("double")))
        .when(is_int, key("i", text=F.regexp_replace(digits, r"^0+(?=.)", "")))
        .when(col.isNotNull(), key("s", text=strip(col)))
    )


def same_answer(left: Column, right: Column) -> Column:
    """True where two answers have equal keys."""
    return answer_key(left).eqNullSafe(answer_key(right))
