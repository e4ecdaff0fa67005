"""Filters (D1-D12): one composite predicate so Catalyst can push it into the scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PORT_PRESETS = ("all", "system", "user", "dynamic", "custom")


@dataclass(frozen=True)
class FilterSpec:
    """Dashboard filter state. ``None`` means "no restriction" for list filters.

    ``start``/``end`` form a half-open range ``[start, end)``; with ``inclusive_midnight`` the
    end bound is ``<=`` (the batch report's behaviour, which keeps only midnight of the last day).
    """
    protocols: tuple | None = None
    port_range: str = "all"
    port_min: int = 0
    port_max: int = 65535
    actions: tuple | None = None
    start: str | date | datetime | None = None
    end: str | date | datetime | None = None
    inclusive_midnight: bool = False
    rules: tuple | None = None
    ips: tuple | None = None


def port_predicate(preset: str, port: Column | None = None, lo: int = 0, hi: int = 65535) -> Column:
    p = F.col("dest_port") if port is None else port
    if preset == "all":
        return F.lit(True)
    if preset == "system":
        return p < 1024
    if preset == "user":
        return (p >= 1024) & (p < 49152)
    if preset == "dynamic":
        return p >= 49152
    if preset == "custom":
        return p.between(lo, hi)
    raise ValueError(f"unknown port preset {preset!r}; expected one of {PORT_PRESETS}")


def _ts(v):
    return F.lit(v).cast("timestamp_ntz")


def date_predicate(start=None, end=None, inclusive_midnight: bool = False, col: str = "date") -> Column:
    d = F.col(col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= _ts(start))
    if end is not None:
        cond = cond & ((d <= _ts(end)) if inclusive_midnight else (d < _ts(end)))
    return cond


def predicate(spec: FilterSpec) -> Column:
    """The whole spec as one Column (null-safe: a null field never passes a restriction)."""
    cond = port_predicate(spec.port_range, lo=spec.port_min, hi=spec.port_max)
    if spec.protocols is not None:
        cond = cond & F.col("protocol").isin(list(spec.protocols))
    if spec.actions is not None:
        cond = cond & F.col("action").isin(list(spec.actions))
    if spec.rules is not None:
        cond = cond & F.col("rule_id").isin(list(spec.rules))
    if spec.ips is not None:
        cond = cond & F.col("ip_source").isin(list(spec.ips))
    if spec.start is not None or spec.end is not None:
        cond = cond & date_predicate(spec.start, spec.end, spec.inclusive_midnight)
    return F.coalesce(cond, F.lit(False))


def apply_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Filter by the spec. On a day-partitioned flow table (a ``day`` column, as written by
    ``write_daily_index``) the date range is also applied to ``day``, so whole day folders are
    pruned at planning time."""
    out = df.filter(predicate(spec))
    if "day" in df.columns and (spec.start is not None or spec.end is not None):
        d = F.col("day")
        if spec.start is not None:
            out = out.filter(d >= F.to_date(_ts(spec.start)))
        if spec.end is not None:
            out = out.filter(d <= F.to_date(_ts(spec.end)))
    return out


def selectivity(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Kept rows, total rows and kept percent in one pass (no second scan)."""
    return df.agg(
        F.count_if(predicate(spec)).alias("kept"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("pct", F.round(F.lit(100.0) * F.col("kept") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 2))


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Guard for operators that need at least one row (raises ValueError on empty input)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def last_n_days(df: DataFrame, n: int, col: str = "date") -> DataFrame:
    """Rows of the last ``n`` days before the newest event (the timeline's look-back presets)."""
    newest = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) >= newest - F.make_interval(days=F.lit(n)))


def look_back(df: DataFrame, span: str, col: str = "date") -> DataFrame:
    """Rows of a look-back: ``all``, ``<n> days`` or ``<n> months`` (calendar months) before the newest event."""
    if span == "all":
        return df
    n, unit = span.split()
    if unit == "days":
        return last_n_days(df, int(n), col)
    if unit != "months":
        raise ValueError(f"unknown look-back {span!r}")
    newest = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) >= newest - F.make_ym_interval(months=F.lit(int(n))))
