"""Stop-visit expressions: delays, best time, mode inference, line names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metroscope.functions.text import strip

# Line codes known to be RER lines when no mode is published.
KNOWN_RER_CODES = ("C01742", "C01743", "C01727", "C01728", "C01729")
# Published vehicle mode (lower case) -> fact mode.
PUBLISHED_MODE_MAP = {"metro": "metro", "rail": "rer", "tram": "tram", "bus": "bus"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _seconds_truncated(later: Column, earlier: Column) -> Column:
    # Whole seconds, truncated toward zero like int() of a timedelta.
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(-F.floor(-micros / 1_000_000))


def delay_seconds(aimed_arrival="aimed_arrival", expected_arrival="expected_arrival",
                  aimed_departure="aimed_departure", expected_departure="expected_departure") -> Column:
    """Stored delay: the arrival pair if both are known, else the departure pair (NULL beyond 32 bits)."""
    aa, ea, ad, ed = map(_c, (aimed_arrival, expected_arrival, aimed_departure, expected_departure))
    return (F.when(aa.isNotNull() & ea.isNotNull(), _seconds_truncated(ea, aa))
            .when(ad.isNotNull() & ed.isNotNull(), _seconds_truncated(ed, ad))
            .try_cast("int"))


def arrival_delay_seconds(aimed="aimed_arrival", expected="expected_arrival") -> Column:
    """Dashboard delay: arrival pair only, fractional seconds (DOUBLE)."""
    return (F.unix_micros(_c(expected)) - F.unix_micros(_c(aimed))).cast("double") / F.lit(1e6)


def best_time(expected_arrival="expected_arrival", expected_departure="expected_departure",
              aimed_arrival="aimed_arrival", aimed_departure="aimed_departure") -> Column:
    return F.coalesce(*map(_c, (expected_arrival, expected_departure, aimed_arrival, aimed_departure)))


def short_line_code(line_id) -> Column:
    """Last non-empty ':'-separated part (``STIF:Line::C01371:`` -> ``C01371``)."""
    parts = F.filter(F.split(_c(line_id), ":"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def blank_to_null(x) -> Column:
    t = strip(x)
    return F.when(t != "", t)


def line_name(published_name, journey_note, line_id) -> Column:
    """Published line name, else journey note, else the short code of the id."""
    return F.coalesce(blank_to_null(published_name), blank_to_null(journey_note), short_line_code(line_id))


def operator_name(raw_operator) -> Column:
    """``STIF:Operator::RATP:`` -> ``RATP``; the raw text when nothing is left."""
    raw = _c(raw_operator)
    parts = F.filter(F.split(raw, ":"), lambda p: (p != "") & (p != "STIF") & (p != "Operator"))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")) \
            .when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(raw)


def infer_mode(published_mode, line_id, operator) -> Column:
    """Published mode, else a known RER code, else SNCF operator -> train, else unknown."""
    pm = F.lower(_c(published_mode))
    explicit = None
    for k, v in PUBLISHED_MODE_MAP.items():
        explicit = F.when(pm == k, F.lit(v)) if explicit is None else explicit.when(pm == k, F.lit(v))
    code = short_line_code(line_id)
    return F.coalesce(
        explicit,
        F.when(code.isin(*KNOWN_RER_CODES), F.lit("rer")),
        F.when(F.upper(_c(operator)).contains("SNCF"), F.lit("train")),
        F.lit("unknown"),
    )


def display_name(short_name, long_name, line_id) -> Column:
    """Short name, else long name (empty strings skipped), else the id's code."""
    return F.coalesce(F.nullif(_c(short_name), F.lit("")), F.nullif(_c(long_name), F.lit("")),
                      short_line_code(line_id), _c(line_id))


def build_line_id(raw_id) -> Column:
    """``C01390`` -> ``STIF:Line::C01390:``; empty or NULL -> NULL."""
    r = _c(raw_id)
    return F.when(r.isNotNull() & (r != ""), F.concat(F.lit("STIF:Line::"), r, F.lit(":")))


def normalize_color(raw) -> Column:
    """Trim, drop leading '#', upper-case; exactly 6 characters or NULL."""
    cleaned = F.upper(F.regexp_replace(strip(raw), r"^#+", ""))
    return F.when(F.length(cleaned) == 6, F.concat(F.lit("#"), cleaned))


def journey_slug(label) -> Column:
    return F.lower(F.replace(_c(label), F.lit(" "), F.lit("-")))


def vehicle_journey_key(vehicle_journey_id="vehicle_journey_id") -> Column:
    """Key part of the load key: NULL journeys compare equal as ''."""
    return F.coalesce(_c(vehicle_journey_id), F.lit(""))
