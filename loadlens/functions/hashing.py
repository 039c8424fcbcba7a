"""Hash expressions any engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: Column, seed: int) -> Column:
    """Hex hash of ``seed`` and ``key``; its text order is a seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def token_id(token: Column, vocabulary: int) -> Column:
    """Id of a token in a hashed vocabulary."""
    return F.pmod(
        F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"),
        F.lit(vocabulary),
    ).cast("int")
