"""Languages of texts: script ranges, per-word scores, and Viterbi over the words of a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.llm.words import U64, constants, mix, slices

BITS = 16           # n-gram buckets for each language
ORDERS = (1, 2, 3)  # characters in an n-gram; words are closed by a mark on either side
SWITCH = 8.0        # nats a change of language costs
UNKNOWN = "und"
MAX_LANGUAGES = 256
# Combining marks: accents, vowel signs, points.  A word is letters with the marks on them.
_MARKS = "".join(c for c in map(chr, [*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)])
                 if unicodedata.category(c)[0] == "M")
_MARK = re.compile(f"[{_MARKS}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKED = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")


def _split(text: str) -> list[str]:
    """Words of a text: letters with their marks; the plain pattern does where no mark occurs."""
    marked = not text.isascii() and max(text) >= "\u0300" and _MARK.search(text)
    return (_MARKED if marked else _LETTERS).findall(text)

# First code point of a script, and its name.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1400, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0xFF21, "latin"),
    (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_FROM = np.array([first for first, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


class Model(NamedTuple):
    """Languages in text order, log shares by bucket and language, and languages of a script."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


class _Memo(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words of a batch, the number of each word, and offsets by text."""
    memo = _Memo()
    ids, counts = [], [0]
    for text in texts.to_pylist():
        words = _split(text.lower()) if text else ()
        ids.append(np.fromiter(map(memo.__getitem__, words), np.int32, len(words)))
        counts.append(len(words))
    return list(memo), np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(counts)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, offsets by word, and the script of each word."""
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    gaps = np.flatnonzero(points == 32)
    starts, sizes = gaps[:-1], np.diff(gaps) + 1
    script = _SCRIPT[np.searchsorted(_FROM, points[starts + 1].astype(np.int64), "right") - 1]
    factors = constants(max(ORDERS), 23)
    # Single characters stand without the marks, longer n-grams with them.
    counts = [np.maximum(sizes - 2 if n == 1 else sizes - n + 1, 0) for n in ORDERS]
    offsets = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    out = np.empty(int(offsets[-1]), np.int64)
    place = offsets[:-1].copy()
    for n, count in zip(ORDERS, counts, strict=True):
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(starts + (n == 1), count) + inner
        value = np.full(len(at), U64(n))
        for j in range(n):
            value = value * factors[j] + points[at + j]
        out[np.repeat(place, count) + inner] = (mix(value) >> U64(64 - BITS)).astype(np.int64)
        place += count
    return out, offsets, script


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, id, n): n-gram counts by bucket, and word counts by script from id 2 ** BITS on."""
    width = (1 << BITS) + len(_NAMES)
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            words, ids, offsets = _words(part.column("text"))
            if not words:
                continue
            grams, at, script = _grams(words)
            langs = np.array(part.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(langs)), np.diff(offsets))
            for lang in set(langs.tolist()):
                n = np.bincount(ids[langs[of] == lang], minlength=len(words))
                sums = found.setdefault(lang, np.zeros(width, np.int64))
                sums[:1 << BITS] += np.bincount(
                    grams, np.repeat(n, np.diff(at)), 1 << BITS).astype(np.int64)
                sums[1 << BITS:] += np.bincount(script, n, len(_NAMES)).astype(np.int64)
    for lang, sums in found.items():
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(sums[ids])],
            ["lang", "id", "n"])


def train(docs: DataFrame, share: float = 0.01, smooth: float = 0.5) -> Model:
    """Learn from all rows of ``docs`` (text, lang) with a language.

    A script admits the languages that have at least ``share`` of their words in it.  What
    reaches the driver is one count for each language and bucket; more than MAX_LANGUAGES
    languages are refused.  Without a labelled word the model knows no language.
    """
    sums = (docs.filter("lang is not null").select("text", "lang")
            .mapInArrow(_counted, "lang string, id long, n long")
            .groupBy("lang", "id").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in
                       sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), (1 << BITS) + len(_NAMES)))
    table = sums.toArrow()
    rows = np.searchsorted(np.array(languages, object), table["lang"].to_numpy())
    counts[rows, table["id"].to_numpy()] = table["n"].to_numpy()
    grams, scripts = counts[:, :1 << BITS], counts[:, 1 << BITS:]
    scores = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * (1 << BITS)))
    allowed = scripts >= share * np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed[:, ~allowed.any(axis=0)] = True
    return Model(languages, scores.T.astype(np.float32), allowed.T)


def _emissions(words: list[str], model: Model) -> np.ndarray:
    """Log share of each language for each distinct word; a script's strangers are far below."""
    grams, at, script = _grams(words)
    raw = np.empty((len(words), len(model.languages)), np.float32)
    for j in range(len(model.languages)):
        raw[:, j] = np.add.reduceat(model.scores[grams, j], at[:-1])
    raw[~model.allowed[script]] -= 1e4
    raw -= raw.max(axis=1, keepdims=True)
    raw -= np.log(np.exp(raw).sum(axis=1, keepdims=True))
    return np.maximum(raw, -12)


def _viterbi(ids: np.ndarray, offsets: np.ndarray, scores: np.ndarray,
             penalty: float) -> np.ndarray:
    """Best language of every word, all texts of a batch at once, the longest first."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    first, left = offsets[:-1][order], sizes[order]
    active = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
    switch = np.zeros((len(ids), scores.shape[1]), bool)
    best = np.zeros(len(ids), np.int16)
    state = np.zeros((len(left), scores.shape[1]), np.float32)
    ends = np.zeros(len(left), np.int16)
    for t, n in enumerate(active.tolist()):
        at = first[:n] + t
        now = state[:n]
        if t:
            top = now.argmax(axis=1)
            best[at] = top
            change = (now.max(axis=1) - penalty)[:, None]
            switch[at] = change > now
            now = np.maximum(now, change)
        now = now + scores[ids[at]]
        state[:n] = now
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        after = int(active[t + 1]) if t + 1 < len(active) else 0
        if n > after:
            ends[after:n] = state[after:n].argmax(axis=1)
        at = first[:n] + t
        now = ends[:n].copy()
        moved = switch[at, now]
        ends[:n] = np.where(moved, best[at], now)
        best[at] = now
    return best


def label(docs: DataFrame, model: Model, penalty: float = SWITCH,
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and spans by its column text.

    ``keep`` names the columns to return besides (all if not given); columns with the names of
    the new ones are replaced.  Spans are maximal runs of words (start, words, lang) of one
    language on the best path; words are runs of letters with the combining marks on them.
    lang_pred is the language of most letters (marks count too), the first in text order on a
    tie, and score its share of the letters.  A text that is null or has no letter, or any text
    when nothing was learned, is ``und`` with score 0 and no spans.  Very long texts are read
    whole; an empty table gives an empty result.
    """
    languages = [*model.languages]
    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "spans")]
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield labelled(part)

    def labelled(part: pa.RecordBatch) -> pa.RecordBatch:
        words, ids, offsets = _words(part.column("text"))
        n, sizes = part.num_rows, np.diff(offsets)
        known = (sizes > 0) & bool(languages)
        share = np.zeros(n)
        names = np.full(n, UNKNOWN, object)
        spans = pa.array([[]] * n, _SPANS)
        if known.any():
            path = _viterbi(ids, offsets, _emissions(words, model), penalty)
            letters = np.fromiter(map(len, words), np.int64, len(words))[ids]
            of = np.repeat(np.arange(n), sizes)
            sums = np.bincount(of * len(languages) + path, letters,
                               n * len(languages)).reshape(n, -1)
            names[known] = np.array(languages, object)[sums.argmax(axis=1)][known]
            share[known] = (sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1))[known]
            begin = np.ones(len(ids), bool)
            begin[1:] = (path[1:] != path[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(begin)
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(begin, offsets), pa.int32()),
                pa.StructArray.from_arrays([
                    pa.array(begin - offsets[of[begin]]),
                    pa.array(np.diff(np.append(begin, len(ids)))),
                    pa.array(np.array(languages, object)[path[begin]], pa.string())],
                    ["start", "words", "lang"]))
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(share),
             spans], [*keep, "lang_pred", "score", "spans"])

    added = T.StructType.fromDDL(
        "lang_pred string, score double, "
        "spans array<struct<start: bigint, words: bigint, lang: string>>")
    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added.fields))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key's text, modulo ``by``."""
    return F.crc32(key.cast("string").cast("binary")) % by


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Language of every document, learned from the documents that carry one.

    Returns ``keep`` (doc_id if not given), held_out, lang_pred, score and spans.  Documents
    whose crc32(doc_id) mod 3 is 1 are held out, and those without doc_id are not learned from
    either.  Repeated rows get equal results; columns beyond doc_id, text and lang are not read.
    """
    rest = remainder(F.col("doc_id").cast("long"), 3)
    model = train(docs.filter(rest != 1))
    keep = [c for c in keep or ["doc_id"] if c != "held_out"]
    return label(docs.withColumn("held_out", F.coalesce(rest == 1, F.lit(False))), model,
                 keep=[*keep, "held_out"])
