"""Checks on column names, made before any job runs."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def require_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> list[str]:
    """Names of ``cols`` that ``df`` lacks: an error when ``strict``, else a warning."""
    missing = [c for c in cols if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if missing:
        log.warning("missing columns: %s", ", ".join(missing))
    return missing


def unused(columns: Sequence[str], *wanted: str) -> list[str]:
    """``wanted`` names with as many underscores behind as keep them apart from ``columns``."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
