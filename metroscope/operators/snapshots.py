"""Trailing time windows and latest-row-per-key snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metroscope.operators.common import materialize


def as_of_value(as_of=None) -> Column:
    """``as_of`` as a TIMESTAMP column: a literal, a column, or now."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def since(as_of=None, hours: float | None = None, days: float | None = None) -> Column:
    """Lower bound ``as_of - interval`` (hours or days)."""
    micros = int(round(((hours or 0) * 3600 + (days or 0) * 86400) * 1_000_000))
    return F.timestamp_micros(F.unix_micros(as_of_value(as_of)) - F.lit(micros))


def trailing(df: DataFrame, ts: str, as_of=None, hours: float | None = None, days: float | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - window``; like ``NOW() - INTERVAL`` there is
    no upper bound.  A literal ``as_of`` folds to a constant, so the
    predicate reaches the parquet scan (row-group / partition pruning)."""
    return df.filter(F.col(ts) >= since(as_of, hours, days))


MAX_PEAKS = 1_000_000  # keys (one time each) broadcast to find the latest rows


def peaks(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Latest time of every key: a hash aggregate of one fixed-width buffer, no sort."""
    return df.groupBy(*keys).agg(F.max(ts).alias("__peak"))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str] | None = None,
                   tie_cols: Sequence[str] = (), max_keys: int = MAX_PEAKS) -> DataFrame:
    """Latest row per key (``DISTINCT ON (key) ... ORDER BY ts DESC``).

    The latest time of every key is found by a hash aggregate and written
    once; the rows at that time are picked by a broadcast join on (key, time)
    while the input is scanned, so rows neither move nor get sorted, and only
    the few rows left are compared for ties.  Ties go to the largest
    (``tie_cols``, then the other columns in order).  The times are broadcast
    only up to ``max_keys`` keys (counted); with more, rows are reduced by key
    as they are (``reduce_latest``).  A key without any time keeps a row.
    """
    cols = list(cols) if cols is not None else list(df.columns)
    if df.isStreaming:
        return reduce_latest(df, keys, ts, cols, tie_cols)
    top = materialize(peaks(df, keys, ts))  # one row per key
    if top.limit(max_keys + 1).count() > max_keys:
        return reduce_latest(df, keys, ts, cols, tie_cols)
    named = top.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__peak")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(ts).eqNullSafe(F.col("__peak")))
    rows = df.join(F.broadcast(named), same, "left_semi")
    return reduce_latest(rows, keys, ts, cols, tie_cols)


def reduce_latest(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], tie_cols: Sequence[str] = ()) -> DataFrame:
    """Latest row per key as ``max(struct(ts, ties..., payload...))``.

    The aggregate is partial (map-side), so even a key holding a third of all
    rows is reduced in every task before the shuffle, and the struct order
    makes the survivor deterministic on ties; structs are compared in sorted runs.
    """
    payload = [c for c in cols if c not in keys and c != ts and c not in tie_cols]
    packed = F.struct(*[F.col(ts).alias("__ts")], *[F.col(c).alias(f"__t{i}") for i, c in enumerate(tie_cols)],
                      *[F.col(c) for c in payload])
    out = df.groupBy(*keys).agg(F.max(packed).alias("__l"))
    sel = [F.col(k) for k in keys]
    for c in cols:
        if c in keys:
            continue
        if c == ts:
            sel.append(F.col("__l.__ts").alias(ts))
        elif c in tie_cols:
            sel.append(F.col(f"__l.__t{list(tie_cols).index(c)}").alias(c))
        else:
            sel.append(F.col(f"__l.{c}").alias(c))
    return out.select(*sel)


def latest_within(df: DataFrame, keys: Sequence[str], ts: str, as_of=None, hours: float = 6,
                  cols: Sequence[str] | None = None, tie_cols: Sequence[str] = ()) -> DataFrame:
    return latest_per_key(trailing(df, ts, as_of, hours=hours), keys, ts, cols, tie_cols)


# Snapshot column lists of the scoring, dashboard and fact-text readers.
AIR_SCORING_COLS = ["station_id", "station_name", "latitude", "longitude", "aqi", "pm25", "pm10", "no2", "measured_at"]
WEATHER_SCORING_COLS = ["point_id", "point_name", "latitude", "longitude", "temperature_c", "precipitation_mm",
                        "wind_speed_ms", "uv_index", "observed_at"]
AIR_DASHBOARD_COLS = ["station_id", "station_name", "latitude", "longitude", "aqi", "pm25", "pm10", "no2", "o3",
                      "temperature_c", "humidity_pct", "measured_at", "attribution"]


def latest_air(air: DataFrame, as_of=None, hours: float = 6, cols=AIR_SCORING_COLS) -> DataFrame:
    """Latest air row per station within ``hours`` (6 h scoring, 24 h dashboard)."""
    return latest_within(air, ["station_id"], "measured_at", as_of, hours, cols)


def latest_weather(weather: DataFrame, as_of=None, hours: float = 3, cols=WEATHER_SCORING_COLS) -> DataFrame:
    """Latest weather row per point within ``hours`` (3 h)."""
    return latest_within(weather, ["point_id"], "observed_at", as_of, hours, cols)


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """First row per key in arrival order (smallest ``order_cols``).

    Used for "first occurrence wins" de-duplication; unlike a bare
    ``dropDuplicates`` the survivor is deterministic.  Partial aggregate, so
    hot keys are pre-reduced map-side.
    """
    payload = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in payload])
    out = df.groupBy(*keys).agg(F.min(packed).alias("__f"))
    sel = []
    for c in df.columns:
        if c in keys:
            sel.append(F.col(c))
        elif c in order_cols:
            sel.append(F.col(f"__f.__o{list(order_cols).index(c)}").alias(c))
        else:
            sel.append(F.col(f"__f.{c}").alias(c))
    return out.select(*sel)
