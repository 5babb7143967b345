"""Registered queries: each runs a library operator over the driver tables.

Every entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
independent DuckDB SQL oracle over the same tables (or ``None`` where the
operator is not expressible in SQL).  Computed columns carry the same alias
on both sides; floating results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.plans import adapters as A

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # every feed time is UTC; pin the session zone whatever session the caller built
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        REGISTRY[name] = (run, oracle)
        return fn
    return deco


# Output rounding of doubles to 6 digits.  Step-valued scores often average
# to exact 7th-digit ties, which engines round differently (decimal vs
# binary); a 1e-9 nudge moves every tie the same way in both.
ROUND_NUDGE = 1e-9


def r6(c):
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(ROUND_NUDGE), 6)


def r6_pairs(c):
    """``r6`` for results with a row per pair: the same double, in double arithmetic.

    Decimals are built only within rounding of a tie or for large values.  A
    whole number of millionths below 2**53 over 10**6 is the double nearest to that decimal.
    """
    x = (F.col(c) if isinstance(c, str) else c) + F.lit(ROUND_NUDGE)
    t = x * F.lit(1e6)
    whole = F.rint(t)
    clear = (F.abs(t) < 1e9) & (F.abs(t - whole) < 0.4999)
    return F.when(clear, (whole + F.lit(0.0)) / F.lit(1e6)).otherwise(F.round(x, 6))


def sql_r6(expr: str) -> str:
    return f"round({ROUND_NUDGE} + ({expr}), 6)"


AS_OF_SQL = f"TIMESTAMP '{A.AS_OF}'"


# ---------------------------------------------------------------- shared logical tables
def visits(spark, d):
    from metroscope.operators.facts import stop_visit_rows
    return stop_visit_rows(A.stop_visits_raw(spark, d))


VIEWS_ALL = {
    "stop_visits": A.SQL_STOP_VISITS, "air": A.SQL_AIR, "weather": A.SQL_WEATHER,
    "lines": A.SQL_LINES, "waypoints": A.SQL_WAYPOINTS, "journeys": A.SQL_JOURNEYS,
}


def views(*names: str) -> dict[str, str]:
    return {n: VIEWS_ALL[n] for n in names}


from metroscope.plans import q_scoring, q_delays, q_text, q_ingest, q_streaming  # noqa: E402,F401
