"""Near-duplicate documents by SimHash with a positional byte index and count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.llm.graph import components
from loadlens.llm.words import U64, Words, slices
from loadlens.sources.store import stored

K = 3        # words of a shingle
SEED = 42    # of XXH64
RADIUS = 3   # differing bits of linked fingerprints
BYTES = 8    # of a fingerprint
# At most RADIUS bytes hold a differing bit, so linked fingerprints share this many.
SHARED = BYTES - RADIUS
# Shingles whose bits are counted at a time.
_CHUNK = 1 << 17
# Members of an open posting list that are paired one by one; longer lists go by masks.
_FEW = 64


def _joined(words: Words, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins and ends."""
    lengths = words.end - words.first
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    shift = np.repeat(words.first - begin[:-1], lengths)
    inside = np.arange(len(shift)) + np.repeat(np.arange(len(lengths)), lengths)
    out[inside] = data[inside + shift]
    return out.tobytes(), begin[:-1], begin[:-1] + lengths


def fingerprints_of(texts: pa.Array, k: int = K) -> np.ndarray:
    """Fingerprints of a batch of texts as unsigned 64-bit numbers, most significant bit first.

    A bit is set if more than half of the hashes of the text's shingles have it; without words
    it is zero.  Bits are counted for a bounded number of shingles at a time.
    """
    words = Words(texts)
    data = words.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    whole, begin, end = _joined(words, data)
    begins, ends = begin.tolist(), end.tolist()
    counts = np.zeros((len(texts), 64), np.int64)
    n = np.diff(words.bounds)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    digest = xxhash.xxh64_intdigest
    owners: list[int] = []
    hashes: list[int] = []

    def count() -> None:
        if not hashes:
            return
        own = np.array(owners)
        bits = np.unpackbits(np.array(hashes, U64).astype(">u8").view(np.uint8).reshape(-1, 8),
                             axis=1)
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        owners.clear()
        hashes.clear()

    for row, (low, high) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(),
                                          strict=True)):
        if low == high:
            continue
        behind = min(k, high - low) - 1
        last = high - behind
        for start in range(low, last, _CHUNK):
            stop = min(last, start + _CHUNK)
            hashes += [digest(whole[a:b], SEED) for a, b in zip(
                begins[start:stop], ends[start + behind:stop + behind], strict=True)]
            owners += [row] * (stop - start)
            if len(hashes) >= _CHUNK:
                count()
    count()
    ones = 2 * counts > shingles[:, None]
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(U64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = fingerprints_of(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    """The byte of ``fp`` at place ``i`` from the left."""
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(255))


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def shared_bytes(x: Column, y: Column) -> Column:
    """How many places hold the same byte in both fingerprints."""
    both = x.bitwiseXOR(y)
    return sum((_byte(both, i) == 0).cast("int") for i in range(BYTES))


def _places() -> list[tuple[int, ...]]:
    return list(combinations(range(BYTES), SHARED))


def _kept_bits(places: tuple[int, ...]) -> int:
    """The mask of the bytes at ``places``, as a signed long."""
    mask = sum(255 << 8 * (BYTES - 1 - i) for i in places)
    return mask - (1 << 64) if mask >> 63 else mask


def postings(prints: DataFrame) -> DataFrame:
    """(slot, held, fp): the index of fingerprints by the bytes at every SHARED places.

    Lists of single bytes would each hold a 256th of all documents.  A pair that shares the
    guaranteed number of bytes shares one list of these, and lists stay short.
    """
    masks = F.array(*[F.lit(_kept_bits(p)) for p in _places()])
    return prints.select("fp", F.posexplode(masks).alias("slot", "mask")).select(
        "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("held"), "fp")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the guaranteed number of shared bytes and few enough differing bits."""
    a, b = F.col("a"), F.col("b")
    return pairs.filter(shared_bytes(a, b) >= SHARED).filter(_distance(a, b) <= RADIUS)


def _free_bits() -> Column:
    """By slot, the places of the bits that the lists of this slot leave free."""
    free = [[8 * (BYTES - 1 - i) + bit for i in range(BYTES) if i not in p for bit in range(8)]
            for p in _places()]
    return F.array(*[F.array(*[F.lit(b) for b in bits]) for bits in free])


def _masked(members: DataFrame) -> DataFrame:
    """Members (slot, held, fp) under each choice of RADIUS free bits, which are cleared.

    Two members differ in RADIUS bits or fewer exactly if they agree under one choice, and all
    that agree under it are links of one another.
    """
    bits = members.withColumn("bits", F.get(_free_bits(), F.col("slot")))
    cleared, last = F.lit(0).cast("long"), F.lit(-1)
    for i in range(RADIUS):
        rest = F.sequence(last + 1, F.lit(8 * RADIUS - RADIUS + i))
        bits = bits.withColumn(f"i{i}", F.explode(rest))
        last = F.col(f"i{i}")
        cleared = cleared.bitwiseOR(F.expr(f"shiftleft(1L, get(bits, i{i}))"))
    return bits.select("fp", cleared.alias("cleared"),
                       F.col("fp").bitwiseAND(F.bitwise_not(cleared)).alias("rest"))


def _members(prints: DataFrame) -> DataFrame:
    """(slot, held, low, fp, place) of all members of a list but its smallest, ``low``.

    The index is shuffled once.  A list holds distinct fingerprints that share five bytes, so it
    has 2 ** 24 members at most, and its sorted members pass by one at a time.
    """
    in_list = Window.partitionBy("slot", "held").orderBy("fp")
    return postings(prints).select(
        "slot", "held", "fp", F.first("fp").over(in_list).alias("low"),
        F.row_number().over(in_list).alias("place")).filter("place > 1")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``, enough to connect all within the radius.

    In each list the smallest fingerprint is compared with the others.  Lists whose members are
    then not all connected are compared further: short ones pair by pair, long ones by masks,
    whose number of rows grows with the members and not with their square.
    """
    members = stored(_members(prints))
    found = stored(_verified(members.select(
        F.col("low").alias("a"), F.col("fp").alias("b")).distinct()))
    label = components(found)
    own = label.select(F.col("node").alias("fp"), F.col("component").alias("own"))
    head = label.select(F.col("node").alias("low"), F.col("component").alias("head"))
    named = stored(members.join(own, "fp", "left").join(head, "low", "left").select(
        "slot", "held", "fp", "low", "place", F.coalesce("own", "fp").alias("component"),
        F.coalesce("head", "low").alias("lowest")))
    # A list of two is done; so is one whose members are in one component.
    unfinished = named.groupBy("slot", "held").agg(
        F.max("place").alias("n"), F.max(F.col("component") != F.col("lowest")).alias("several"),
        F.first("low").alias("low"), F.first("lowest").alias("lowest")).filter("several and n > 2")
    unfinished = stored(unfinished.drop("several"))
    open_lists = stored(
        named.join(unfinished.select("slot", "held", "n"), ["slot", "held"]).select(
            "slot", "held", "n", "fp", "component").unionByName(unfinished.select(
                "slot", "held", "n", F.col("low").alias("fp"),
                F.col("lowest").alias("component"))))
    short = open_lists.filter(F.col("n") <= _FEW)
    others = short.select("slot", "held", F.col("fp").alias("b"),
                          F.col("component").alias("other"))
    pairs = short.withColumnRenamed("fp", "a").join(others, ["slot", "held"]).filter(
        "a < b and component <> other").select("a", "b").distinct()
    cliques = _masked(open_lists.filter(F.col("n") > _FEW)).groupBy("cleared", "rest").agg(
        F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    # A clique has 2 ** RADIUS members at most.
    rows = cliques.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return stored(found.unionByName(_verified(pairs)).unionByName(
        rows.filter("a <> b").distinct()))


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, component_id: classes of documents with similar fingerprints.

    Two documents are linked if their fingerprints differ in three bits or fewer; component_id
    is the smallest doc_id reachable over links.  Equal fingerprints are one node, so copies are
    never compared.  A null, empty or blank text has the fingerprint zero and is linked like any
    other.  Very long texts are counted piece by piece.  Rows that repeat a doc_id are each
    returned with the class of their own text.  A row without doc_id is linked too; its class
    has a null name only if no member has a doc_id.  Other columns are ignored, whatever their
    names; an empty table has no rows.
    """
    signed = stored(fingerprints(docs.select("doc_id", "text"), k))
    prints = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(links(prints.select("fp")))
    roots = prints.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return signed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
