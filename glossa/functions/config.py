"""Run-bookkeeping scalars: time stamps, config defaults, config/results merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP_FORMAT = "yyyyMMdd_HHmmss"


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def get_or(m: Column, key: str, default) -> Column:
    """``dict.get(key, default)`` on a map column."""
    return F.coalesce(F.element_at(m, F.lit(key)), F.lit(default))


def merge_right_wins(left: Column, right: Column) -> Column:
    """``{**left, **right}``: keys of ``right`` replace those of ``left``.

    Duplicate keys are resolved explicitly (no reliance on the session's
    ``mapKeyDedupPolicy``): left entries whose key is in ``right`` are dropped.
    """
    rk = F.map_keys(right)
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(rk, k))
    return F.map_concat(kept, right)
