"""Exact substring de-duplication with suffix orders by difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.llm.words import U64, constants, mix, slices, text_bytes

LENGTH = 50                # bytes of a repeated string
_GRAM = 20                 # bytes of an anchor
_SPAN = LENGTH - _GRAM + 1  # anchors in a string
_PLACE = U64((1 << 24) - 1)
_SLICE = 2 << 20
_FLUSH = 1 << 20           # anchors or snippets a task holds before it hands them on
GROUP = 2 << 20            # bytes of text for each group


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of every run of windows with one anchor.

    A window is a string of LENGTH bytes inside one text, named by its first byte; its anchor is
    the place of its smallest hash of _GRAM bytes, the leftmost on a tie.  Equal windows have
    equal anchors at equal places.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    grams = len(data) - _GRAM + 1
    c = constants(3, 31)
    value = mix(eight[:grams] * c[0] + eight[8:grams + 8] * c[1]
                + eight[_GRAM - 8:grams + _GRAM - 8] * c[2])
    # Hash above, place below; a very long text is cut by the caller's slices only between rows.
    if grams > int(_PLACE):
        return _anchors_long(value, offsets, n)
    value = (value & ~_PLACE) | np.arange(grams, dtype=U64)
    low = _sliding_min(value)[:n]
    return _runs((low & _PLACE).astype(np.int64), offsets, n)


def _anchors_long(value: np.ndarray, offsets: np.ndarray, n: int):
    """The same for more bytes than a place holds: piece by piece, pieces overlapping."""
    step = int(_PLACE) - LENGTH
    parts = []
    for begin in range(0, n, step):
        piece = value[begin:begin + step + _SPAN - 1]
        piece = (piece & ~_PLACE) | np.arange(len(piece), dtype=U64)
        low = _sliding_min(piece)[:min(step, n - begin)]
        parts.append((low & _PLACE).astype(np.int64) + begin)
    return _runs(np.concatenate(parts), offsets, n)


def _sliding_min(value: np.ndarray) -> np.ndarray:
    """Minimum of every _SPAN consecutive values."""
    padded = np.concatenate([value, np.full(-len(value) % _SPAN, ~U64(0))]).reshape(-1, _SPAN)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - _SPAN + 1
    return np.minimum(tail[:n], head[_SPAN - 1:_SPAN - 1 + n])


def _runs(place: np.ndarray, offsets: np.ndarray, n: int):
    inside = np.ones(n, bool)
    # Windows that begin less than LENGTH bytes before the end of their text reach beyond it.
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1):end] = False
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(begin)
    stop = ~inside
    stop[1:] |= begin[1:]
    ends = np.append(np.flatnonzero(stop), n)
    last = ends[np.searchsorted(ends, first, "right")] - 1
    return first, last, place[first]


def _anchor_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the anchors at ``at``, independent of those that chose them."""
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    c = constants(3, 37)
    return mix(eight[at] * c[0] + eight[at + 8] * c[1] + eight[at + _GRAM - 8] * c[2])


_TAIL = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("shared", "u1")])


def _pack(rows: np.ndarray) -> bytes:
    """Records of one group, 5 bytes of hash each; the rest is compressed column by column."""
    order = np.lexsort((rows["pos"], rows["doc"]))
    rows = rows[order]
    keys = np.ascontiguousarray(rows["hash"]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    rest = (np.diff(rows["doc"], prepend=0).tobytes() + rows["pos"].tobytes()
            + rows["shared"].tobytes())
    return len(rows).to_bytes(4, "little") + keys + pa.Codec("zstd").compress(
        rest, asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    rows = np.zeros(n, _TAIL)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 4).reshape(n, 5)
    rows["hash"] = keys.view("<u8").ravel()
    rest = pa.Codec("zstd").decompress(blob[4 + 5 * n:], 13 * n, asbytes=True)
    rows["doc"] = np.cumsum(np.frombuffer(rest, "<i8", n))
    rows["pos"] = np.frombuffer(rest, "<i4", n, 8 * n)
    rows["shared"] = np.frombuffer(rest, "u1", n, 12 * n)
    return rows


def _anchor_rows(groups: int):
    """Tasks' anchors by group of their hash.

    A task hands on one record for each anchor it holds.  Where it has seen an anchor in two
    documents, that record says so, and its other places go on as they are (negative group),
    so no group gathers the places of a string found in a large part of all documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                data, offsets = text_bytes(part.column("text"))
                places = np.unique(_anchors(data, offsets)[2])
                if len(places):
                    rows = np.zeros(len(places), _TAIL)
                    rows["hash"] = _anchor_hash(data, places)
                    of = np.searchsorted(offsets, places, "right") - 1
                    rows["doc"] = np.asarray(part.column("doc_id"))[of]
                    rows["pos"] = places - offsets[of]
                    held.append(rows)
                    n += len(rows)
                if n >= _FLUSH:
                    yield sent(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield sent(np.concatenate(held))

    def sent(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.lexsort((rows["doc"], rows["hash"]))]
        begin = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1]))
        size = np.diff(np.append(begin, len(rows)))
        rows["shared"][begin] = rows["doc"][begin] != rows["doc"][begin + size - 1]
        more = np.repeat(rows["shared"][begin].astype(bool), size)
        alone = np.zeros(len(rows), bool)
        alone[begin] = True
        # Other places of an anchor that only one document has go with the record.
        group = ((rows["hash"] >> U64(40)) % U64(groups)).astype(np.int64)
        group[more & ~alone] = -1 - group[more & ~alone]
        order = np.argsort(group, kind="stable")
        group, rows = group[order], rows[order]
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(group[edges[:-1]]),
             pa.array([_pack(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                      pa.binary())], ["part", "anchors"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Places of the anchors that two documents have."""
    rows = np.concatenate([_unpack(b) for b in table.column("anchors").to_pylist()])
    if table.column("part")[0].as_py() >= 0:
        rows = rows[np.argsort(rows["hash"], kind="stable")]
        begin = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1]))
        size = np.diff(np.append(begin, len(rows)))
        several = np.minimum.reduceat(rows["doc"], begin) != np.maximum.reduceat(
            rows["doc"], begin)
        several |= np.maximum.reduceat(rows["shared"], begin) > 0
        rows = rows[np.repeat(several, size)]
    return pa.table({"doc_id": rows["doc"], "pos": rows["pos"]})


def _snippet_rows(groups: int):
    """The bytes of all windows with a shared anchor, by group of the anchor's hash.

    Of equal snippets a task hands on those of its smallest document; in its other documents
    they are repeats already and go on as such (negative group, no bytes).
    """
    names = ["part", "doc_id", "row", "start", "stop", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[tuple]] = {}
        done: list[tuple] = []
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                data, offsets = text_bytes(part.column("text"))
                first, last, place = _anchors(data, offsets)
                if len(first):
                    collect(part, data, offsets, first, last, place, seen, done)
                if len(seen) + len(done) >= _FLUSH // 8:
                    yield sent(seen, done)
                    seen, done = {}, []
        if seen or done:
            yield sent(seen, done)

    def collect(part, data, offsets, first, last, place, seen, done):
        lists = part.column("places")
        wanted = np.asarray(lists.flatten()) + np.repeat(
            offsets[:-1], np.diff(np.asarray(lists.offsets)))
        hit = np.isin(place, wanted)
        first, last, place = first[hit], last[hit] + LENGTH, place[hit]
        if not len(first):
            return
        group = ((_anchor_hash(data, place) >> U64(20)) % U64(groups)).astype(np.int64)
        of = np.searchsorted(offsets, first, "right") - 1
        docs = np.asarray(part.column("doc_id"))[of].tolist()
        rows = np.asarray(part.column("row"))[of].tolist()
        base = offsets[of]
        whole = data.tobytes()
        for a, b, g, doc, row, start, stop in zip(
                first.tolist(), last.tolist(), group.tolist(), docs, rows,
                (first - base).tolist(), (last - base).tolist(), strict=True):
            text = whole[a:b]
            new = (g, doc, row, start, stop, text)
            old = seen.get(text)
            if old is None or doc < old[0][1]:
                seen[text] = [new]
                done += old or ()
            elif doc == old[0][1]:
                old.append(new)
            else:
                done.append(new)

    def sent(seen, done):
        rows = [r for kept in seen.values() for r in kept]
        rows += [(-1 - g, doc, row, start, stop, None) for g, doc, row, start, stop, _ in done]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _dense(keys: np.ndarray) -> np.ndarray:
    """Names 1, 2, 3 ... of the distinct keys, in their order; equal keys may come in any."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    names = np.empty(len(own), np.int64)
    names[order] = np.cumsum(new)
    return names


def _triples(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Names of triples of names below 2 ** 31."""
    top = int(max(x.max(initial=0), y.max(initial=0), z.max(initial=0))) + 1
    if top < 1 << 21:
        return _dense((x * top + y) * top + z)
    return _dense(_dense(x * top + y) * top + z)


def _below(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many of ``keys`` are smaller than each of ``wanted``."""
    return np.searchsorted(np.sort(keys), wanted)


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """``starts`` in the lexicographic order of the suffixes there, to ``depth`` bytes at least.

    The places of the cover, those not divisible by 3, are named by their first seven bytes, and
    then by triples of names, about three times as deep each time (steps are multiples of 3, so
    all places of a triple are in the cover), until names reach the depth.  The remaining
    suffixes are sorted by their first byte and the name behind it and merged: for any i and j,
    one of i + 1, j + 1 and i + 2, j + 2 is a pair in the cover.
    """
    size = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    cover = np.flatnonzero(np.arange(size) % 3)
    slot = np.zeros(size + 3, np.int64)
    slot[cover] = np.arange(1, len(cover) + 1)
    names = np.zeros(len(cover) + 1, np.int64)
    if len(cover):
        seven = np.zeros(len(cover), np.int64)
        for i in range(7):  # bytes and the end of text are 257 values
            seven = seven * 257 + padded[cover + i]
        names[1:] = _dense(seven)
    reach = 7

    def ahead(by: int) -> np.ndarray:
        return names[slot[np.minimum(cover + by, size)]]

    while reach < depth and len(cover):
        step = min(reach - reach % 3, 3 * ((depth - reach + 5) // 6))
        names[1:] = _triples(ahead(0), ahead(step), ahead(2 * step))
        reach += 2 * step
    rank = np.zeros(size + 3, np.int64)
    rank[cover] = names[1:]
    inside, outside = starts[starts % 3 != 0], starts[starts % 3 == 0]
    top = int(rank.max()) + 1
    inside = inside[np.argsort(rank[inside])]
    outside = outside[np.lexsort((rank[outside + 1], padded[outside]))]
    if not len(inside) or not len(outside):
        return np.concatenate([inside, outside])

    # A suffix outside the cover comes behind as many of either class as have a smaller key.
    one, two = inside[inside % 3 == 1], inside[inside % 3 == 2]
    low = _below(padded[one] * top + rank[one + 1], padded[outside] * top + rank[outside + 1])
    low += _below((padded[two] * 257 + padded[two + 1]) * top + rank[two + 2],
                  (padded[outside] * 257 + padded[outside + 1]) * top + rank[outside + 2])
    return np.insert(inside, low, outside)


def _repeats(table: pa.Table) -> pa.Table:
    """Runs of windows of a group that also start in a smaller document."""
    docs, row, start, stop = (
        table.column(c).to_numpy() for c in ("doc_id", "row", "start", "stop"))
    if table.column("part")[0].as_py() < 0:
        return pa.table({"doc_id": docs, "row": row, "start": start, "stop": stop})
    texts = table.column("bytes").combine_chunks()
    size = stop - start
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    windows = size - LENGTH + 1
    of = np.repeat(np.arange(len(size)), windows)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = (ends - size)[of] + inner
    owner = np.zeros(len(text), np.int64)
    owner[places] = np.arange(len(of))
    order = owner[suffix_order(text, places)]
    # Neighbours in the order that agree in a whole window belong together.
    sorted_places = places[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    for by in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        here = eight[sorted_places + by]
        new[1:] |= here[1:] != here[:-1]
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[of[order]], begin)
    repeat = np.zeros(len(of), bool)
    repeat[order] = np.repeat(least, np.diff(np.append(begin, len(order)))) < docs[of[order]]
    first = repeat.copy()
    first[1:] &= ~repeat[:-1] | (of[1:] != of[:-1])
    final = repeat.copy()
    final[:-1] &= ~repeat[1:] | (of[1:] != of[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(final)
    return pa.table({"doc_id": docs[of[a]], "row": row[of[a]], "start": (start[of[a]] + inner[a]).astype(np.int32),
                     "stop": (start[of[b]] + inner[b] + LENGTH).astype(np.int32)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, row, found, gone in zip(batch.column("text"), *(
                batch.column(c).to_pylist() for c in ("row", "found", "gone")), strict=True):
            data = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            whole = [(0, len(data))] if row in (gone or ()) else sorted(
                (f["start"], f["stop"]) for f in found or () if f["row"] == row)
            for start, stop in whole:
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            kept, at = hashlib.sha256(), 0
            for start, stop in spans:
                kept.update(data[at:start])
                at = stop
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(),
                        [{"start": a, "stop": b} for a, b in spans]))
        n, removed, count, digest, spans = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(count, pa.int64()), pa.array(digest, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, stop) of every row.

    A byte is removed if a string of 50 bytes that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input, and matches do not cross documents.

    Every string of 50 bytes has an anchor, the gram of 20 bytes with the smallest hash.  Equal
    strings have equal anchors, so a string can repeat only if two documents have its anchor, and
    all its occurrences are in the group of that anchor.  There is a group for each GROUP bytes of
    text, however many partitions a shuffle has.  Of each group the suffixes are sorted by
    difference cover (``suffix_order``) and neighbours are compared byte by byte.

    A null text is empty.  A row without doc_id has no place in the order: it is returned whole
    and is no reason to remove bytes elsewhere.  Rows that repeat a doc_id are one document, each
    judged by its own text against documents with smaller ids.  Other columns are ignored.
    """
    if docs.schema["doc_id"].dataType != T.LongType():
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = size // GROUP + 1
    row = F.xxhash64("doc_id", "text").alias("row")
    # All joins below are on doc_id alone, so they share one shuffle of the texts.
    known = docs.filter("doc_id is not null").select("doc_id", "text", row)
    copies = _copies(docs)
    own = known.join(copies, "doc_id", "left").filter(
        F.col("gone").isNull() | ~F.array_contains("gone", F.col("row")))
    shared = (own.select("doc_id", "text")
              .mapInArrow(_anchor_rows(groups), "part long, anchors binary")
              .groupBy("part").applyInArrow(_shared, "doc_id long, pos int"))
    places = shared.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    snippets = own.join(places, "doc_id").select("doc_id", "row", "text", "places").mapInArrow(
        _snippet_rows(groups), "part long, doc_id long, row long, start int, stop int, bytes binary")
    repeats = snippets.groupBy("part").applyInArrow(
        _repeats, "doc_id long, row long, start int, stop int")
    found = repeats.groupBy("doc_id").agg(
        F.collect_list(F.struct("row", "start", "stop")).alias("found"))
    cut = known.join(copies, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", "text", "row", "found", "gone")
    rest = docs.filter("doc_id is null").select("doc_id", "text", row)
    return cut.unionByName(rest, allowMissingColumns=True).mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start: long, stop: long>>")


def _copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, gone) whose whole text is that of a document with a smaller doc_id.

    Each of their strings is in that document too, so they are reasons for nothing that it is
    not, and they are removed whole.
    """
    same = ["t1", "t2", "n"]
    texts = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("t1"),
        F.hash("text").alias("t2"), F.octet_length("text").alias("n"))
    firsts = texts.groupBy(*same).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return texts.join(firsts, same).filter("doc_id > first").groupBy("doc_id").agg(
        F.collect_set("row").alias("gone"))
