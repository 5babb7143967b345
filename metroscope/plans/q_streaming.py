"""Registered queries: streaming jobs run with ``availableNow`` over a landing
folder filled from the driver tables; each returns its sink read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from metroscope.functions import mobility as mb
from metroscope.operators import facts
from metroscope.plans import adapters as A
from metroscope.plans import adapters_bronze as B
from metroscope.plans.q_ingest import RAW_E, SQL_AIR_E, VISIT_COLS, _scan_sql
from metroscope.plans.q_scoring import SCORING_VIEWS
from metroscope.plans.queries import AS_OF_SQL, r6, register, sql_r6, views
from metroscope.sources import air as s_air
from metroscope.sources import stop_visits as s_visits
from metroscope.streaming import landing as L
from metroscope.streaming import stateful as S

AS_OF = A.AS_OF
LOAD_KEY = ["stop_id", "line_id", "vehicle_journey_key", "recorded_at"]
ARRIVAL = ["source_file", "delivery_pos", "visit_pos"]  # landed file, delivery and visit position
# Documents land in files of mixed event times, several for every core; a micro-batch takes a third of them.
LANDED_FILES, FILES_PER_TRIGGER = 6, 2
TASKS_PER_CORE = 3


def _journey_key():
    return {"vehicle_journey_key": mb.vehicle_journey_key()}


def _landed(spark, name, docs):
    p = L.scratch(spark, name)
    times = -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // LANDED_FILES)
    L.land(docs.repartition(times * LANDED_FILES, F.xxhash64("event_id")), p["landing"])
    return p, L.stream_scan(spark, p["landing"], times * FILES_PER_TRIGGER)


def _visit_stream(spark, d, name, keep=()):
    p, stream = _landed(spark, name, B.stop_monitoring(spark, d))
    return p, facts.stop_visit_rows(s_visits.scan_stop_visits(stream), keep=keep)


@register("stream_scan", _scan_sql("CAST(NULL AS VARCHAR)"))
def q_stream_scan(spark, d):
    """R1: landing-folder stream -> parsed silver visits, one folder per micro-batch."""
    p, visits = _visit_stream(spark, d, "stream-scan")
    L.append_batches(visits.select(*VISIT_COLS), p["out"], p["ckpt"])
    return spark.read.parquet(p["out"]).drop("batch_id")


@register("stream_dedupe", A.with_views("SELECT DISTINCT stop_id, line_id, recorded_at FROM raw WHERE event_id % 89 <> 0",
                                        raw=RAW_E))
def q_stream_dedupe(spark, d):
    """R2: exact streaming insert-if-absent (each batch through the batch sink)."""
    p, rows = _visit_stream(spark, d, "stream-dedupe", ARRIVAL)
    L.stream_insert_if_absent(rows, p["out"], LOAD_KEY, ARRIVAL, p["ckpt"], _journey_key(), range_col="recorded_at")
    return spark.read.parquet(p["out"]).select("stop_id", "line_id", "recorded_at")


@register("stream_dedupe_watermark", A.with_views(
    "SELECT DISTINCT stop_id, line_id, recorded_at FROM raw WHERE event_id % 89 <> 0", raw=RAW_E))
def q_stream_dedupe_watermark(spark, d):
    """R2 (bounded look-back): on-time rows deduped as they come, late rows set aside and merged."""
    p, rows = _visit_stream(spark, d, "stream-dedupe-wm", ARRIVAL)
    L.stream_insert_bounded(rows, p["out"], p["late"], "recorded_at", "1 DAY", LOAD_KEY, ARRIVAL, p["ckpt"], _journey_key())
    L.merge_late(spark, p["late"], p["out"], LOAD_KEY, ARRIVAL, _journey_key(), range_col="recorded_at")
    return spark.read.parquet(p["out"]).select("stop_id", "line_id", "recorded_at")


@register("stream_first_rows", _scan_sql("CAST(NULL AS VARCHAR)"))
def q_stream_first_rows(spark, d):
    """R2 (state in RocksDB): whole rows of the first arrival per key; late rows found again and added."""
    p, rows = _visit_stream(spark, d, "stream-first", ARRIVAL)
    rows = rows.withColumns(_journey_key())
    S.first_rows(rows, "recorded_at", timedelta(days=1), LOAD_KEY, ARRIVAL, p["out"], p["ckpt"])
    landed = facts.stop_visit_rows(s_visits.scan_stop_visits(
        spark.read.text(p["landing"]).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))), keep=ARRIVAL).withColumns(_journey_key())
    S.set_aside_late(landed, spark.read.schema(landed.schema).parquet(p["out"]), LOAD_KEY, ARRIVAL, p["late"])
    both = spark.read.schema(landed.schema).parquet(p["out"]).unionByName(spark.read.schema(landed.schema).parquet(p["late"]))
    return both.select(*VISIT_COLS)


@register("stream_live_state", A.with_views(f"""
SELECT station_id, station_name, latitude, longitude, aqi, pm25, no2, measured_at FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
  FROM air WHERE event_id % 50 <> 0 AND event_id % 41 <> 0) WHERE rn = 1 AND measured_at >= {AS_OF_SQL} - INTERVAL 6 HOUR""",
    air=SQL_AIR_E))
def q_stream_live_state(spark, d):
    """R5 (state in RocksDB): a station's latest row, dropped from the state after 6 h."""
    p, stream = _landed(spark, "stream-live", B.air_feed(spark, d))
    cols = ["station_id", "station_name", "latitude", "longitude", "aqi", "pm25", "no2", "measured_at"]
    S.live_rows(s_air.scan_air(stream).select(*cols), ["station_id"], "measured_at", timedelta(hours=6), p["out"], p["ckpt"])
    written = spark.read.parquet(p["out"]).drop("batch_id").filter(F.col("measured_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 6 HOURS"))
    return L.live_latest(written, ["station_id"], "measured_at", cols)


@register("stream_hourly", A.with_views("""
SELECT date_trunc('hour', recorded_at) AS hour, count(*) AS count FROM raw WHERE event_id % 89 <> 0 GROUP BY 1""",
                                        raw=RAW_E))
def q_stream_hourly(spark, d):
    """R3: hourly visit counts, partial counts per micro-batch merged on reading."""
    p, visits = _visit_stream(spark, d, "stream-hourly")
    L.write_partials(visits, lambda b: L.hourly_partials(b, "recorded_at"), p["out"], p["ckpt"])
    return L.merge_hourly(spark.read.parquet(p["out"]))


@register("stream_rolling", A.with_views(f"""
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, {sql_r6('avg(CAST(delay_seconds AS DOUBLE))')} AS avg_delay_seconds,
       count(*) AS samples
FROM (SELECT s.*, time_bucket(INTERVAL 30 MINUTE, recorded_at) - k * INTERVAL 30 MINUTE AS window_start
      FROM s, range(4) t(k)) GROUP BY window_start""",
    s=f"SELECT * FROM ({_scan_sql('NULL')}) WHERE delay_seconds IS NOT NULL"))
def q_stream_rolling(spark, d):
    """R4: 2 h windows sliding by 30 min: mean stored delay and samples."""
    p, visits = _visit_stream(spark, d, "stream-rolling")
    L.write_partials(visits, L.rolling_partials, p["out"], p["ckpt"])
    out = L.merge_rolling(spark.read.parquet(p["out"]))
    return out.withColumn("avg_delay_seconds", r6("avg_delay_seconds"))


@register("stream_latest", A.with_views(f"""
SELECT station_id, station_name, latitude, longitude, aqi, pm25, no2, measured_at FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
  FROM air WHERE event_id % 50 <> 0 AND event_id % 41 <> 0) WHERE rn = 1 AND measured_at >= {AS_OF_SQL} - INTERVAL 6 HOUR""",
    air=SQL_AIR_E))
def q_stream_latest(spark, d):
    """R5: live latest row per station; the reader applies the 6 h expiry."""
    p, stream = _landed(spark, "stream-latest", B.air_feed(spark, d))
    air = s_air.scan_air(stream)
    cols = ["station_id", "station_name", "latitude", "longitude", "aqi", "pm25", "no2", "measured_at"]
    L.write_partials(air, lambda b: L.live_latest(b, ["station_id"], "measured_at", cols), p["out"], p["ckpt"])
    latest = L.live_latest(spark.read.parquet(p["out"]).drop("batch_id"), ["station_id"], "measured_at", cols)
    return latest.filter(F.col("measured_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 6 HOURS"))


@register("stream_enrich", A.with_views(f"""
SELECT v.stop_id, v.line_id, v.recorded_at, coalesce(l.short_name, v.line_name, v.line_id) AS display_line_name,
       coalesce(l.transport_mode, v.transport_mode) AS display_mode
FROM ({_scan_sql('NULL')}) v LEFT JOIN lines l ON l.line_id = v.line_id""", **views("lines")))
def q_stream_enrich(spark, d):
    """R6: stream-static join with the line dimension (re-read per batch)."""
    p, visits = _visit_stream(spark, d, "stream-enrich")
    A.lines(spark, d).write.parquet(p["dim"])
    L.stream_enrich(visits, p["dim"], p["out"], p["ckpt"])
    out = spark.read.parquet(p["out"])
    return out.select("stop_id", "line_id", "recorded_at", "display_line_name", "display_mode")
