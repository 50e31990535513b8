"""Expanding ranks and quantiles of bar-level series.

A value is compared with its own past only, which is sequential in time. The input has one row per
bar of a series (a benchmark, an index), so one task per series holds the calendar, never a panel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def expanding_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Quantile ``q`` (linear interpolation) of all values up to each bar."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp")
        return rows.assign(**{name: rows[value].expanding().quantile(q)})

    return _per_series(df, keys, fold, name)


def expanding_rank(df: DataFrame, keys: list[str], value: str, name: str, minimum: int) -> DataFrame:
    """Average-tie percentile of each value among all values up to its bar, from ``minimum`` values on."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp")
        return rows.assign(**{name: rows[value].expanding(min_periods=minimum).rank(pct=True)})

    return _per_series(df, keys, fold, name)


def _per_series(df: DataFrame, keys: list[str], fold, name: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(fold, f"{fields}, `{name}` double")
