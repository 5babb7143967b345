"""Row projection of parsed facts to their silver (sink) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope import schemas
from metroscope.functions.mobility import delay_seconds


def _project(df: DataFrame, schema, computed: dict, defaults: dict, keep=()) -> DataFrame:
    cols = []
    for f in schema.fields:
        if f.name in computed:
            e = computed[f.name]
        elif f.name in df.columns:
            e = F.col(f.name)
            if f.name in defaults:
                e = F.coalesce(e, defaults[f.name])
        elif f.name in defaults:
            e = defaults[f.name]
        else:
            e = F.lit(None)
        cols.append(e.cast(f.dataType).alias(f.name))
    return df.select(*keep, *cols)


def stop_visit_rows(parsed: DataFrame, inserted_at=None, keep=()) -> DataFrame:
    """Parsed stop visits -> ``stop_visits`` columns with the stored delay."""
    return _project(parsed, schemas.STOP_VISIT, {"delay_seconds": delay_seconds()}, {
        "transport_mode": F.lit("unknown"), "source": F.lit(schemas.SOURCE_STOP_VISITS),
        "inserted_at": inserted_at if inserted_at is not None else F.current_timestamp()}, keep)


def air_rows(parsed: DataFrame, inserted_at=None, keep=()) -> DataFrame:
    return _project(parsed, schemas.AIR_MEASUREMENT, {}, {
        "source": F.lit(schemas.SOURCE_AIR),
        "inserted_at": inserted_at if inserted_at is not None else F.current_timestamp()}, keep)


def weather_rows(parsed: DataFrame, inserted_at=None, keep=()) -> DataFrame:
    return _project(parsed, schemas.WEATHER_OBSERVATION, {}, {
        "source": F.lit(schemas.SOURCE_WEATHER),
        "inserted_at": inserted_at if inserted_at is not None else F.current_timestamp()}, keep)
