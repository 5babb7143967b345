"""Raw feed documents built from the driver tables (stand-in bronze input).

Each row of an adapter view is serialised to the JSON shape its feed
returns, with member shapes varied by id (value object vs plain string, list
vs scalar, optional members absent, error statuses, missing geo, empty
deliveries) so the scans meet every shape they must accept.  The documents
carry no derived result: the scans compute everything from the text, and
the oracles compute the expected rows from the plain adapter columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.operators.common import with_barrier
from metroscope.plans import adapters as A


def var(c: Column) -> Column:
    """Any column as a VARIANT member (serialised inline by ``to_json``)."""
    return F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")


def _quoted(c: Column) -> Column:
    """A text as JSON (nothing in it to escape); NULL -> ``null``."""
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _iso(ts: Column, zone: str = "Z") -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))


# Published vehicle mode per fact mode (absent for train / unknown).
PUBLISHED_MODE = {"metro": "metro", "rer": "rail", "tram": "tram", "bus": "bus"}


def stop_monitoring(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One stop-monitoring response per event: ``(event_id, raw)``, with the columns of the visit named by ``keep``."""
    r = A.stop_visits_raw(spark, d, with_event_id=True)
    eid, mode = F.col("event_id"), F.col("transport_mode")
    pub = None
    for k, v in PUBLISHED_MODE.items():
        pub = F.when(mode == k, F.lit(v)) if pub is None else pub.when(mode == k, F.lit(v))
    # The text of a response, member by member in the order of their names (the values hold nothing to escape).
    iso, iso_utc = (lambda c: _quoted(_iso(F.col(c)))), (lambda c: _quoted(_iso(F.col(c), "+00:00")))
    held = lambda c: _text('{"value":', _quoted(c), "}")
    listed = lambda c: _text("[", held(c), "]")
    null = F.lit("null")
    call = _text('{"AimedArrivalTime":', iso("aimed_arrival"), ',"AimedDepartureTime":', iso("aimed_departure"),
                 ',"ArrivalStatus":', _quoted(F.col("arrival_status")), ',"DepartureStatus":', _quoted(F.col("departure_status")),
                 ',"ExpectedArrivalTime":', iso_utc("expected_arrival"), ',"ExpectedDepartureTime":', iso_utc("expected_departure"),
                 ',"StopPointName":', listed(F.concat(F.lit("Arrêt "), F.col("stop_id"))), "}")
    journey = _text('{"DestinationName":', F.when(eid % 2 == 1, listed(F.col("direction"))).otherwise(null),
                    ',"DirectionName":', F.when(eid % 2 == 0, listed(F.col("direction"))).otherwise(null),
                    ',"FramedVehicleJourneyRef":{"DataFrameRef":{"value":"2024"},"DatedVehicleJourneyRef":', held(F.col("vehicle_journey_id")),
                    '},"LineRef":', F.when(eid % 2 == 0, held(F.col("line_id"))).otherwise(_quoted(F.col("line_id"))),
                    ',"MonitoredCall":', call,
                    ',"OperatorRef":', F.when(F.col("operator").isNotNull(), held(F.concat(F.lit("STIF:Operator::"), F.col("operator"), F.lit(":")))).otherwise(null),
                    ',"PublishedLineName":', F.when(eid % 4 != 1, listed(F.col("line_name"))).otherwise(null),
                    ',"VehicleMode":', F.when(pub.isNotNull() & (eid % 2 == 0), _text("[", _quoted(pub), "]")).otherwise(_quoted(pub)), "}")
    visit = _text('{"ItemIdentifier":', _quoted(F.concat(F.lit("ITEM:"), eid.cast("string"))), ',"MonitoredVehicleJourney":', journey,
                  ',"MonitoringRef":', F.when(eid % 89 != 0, held(F.col("stop_id"))).otherwise(null),
                  ',"RecordedAtTime":', F.when(eid % 5 != 0, iso("recorded_at")).otherwise(null), "}")
    empty = F.when(eid % 3 == 0, F.lit('{"version":"2.0","MonitoredStopVisit":[]},')).otherwise(F.lit(""))
    answered = F.coalesce(F.concat(F.lit('"ResponseTimestamp":"'), _iso(F.col("recorded_at")), F.lit('",')), F.lit(""))
    doc = _text('{"Siri":{"ServiceDelivery":{', answered, '"StopMonitoringDelivery":[', empty,
                '{"version":"2.0","MonitoredStopVisit":[', visit, "]}]}}}")
    return with_barrier(r.select("event_id", doc.alias("raw"), *keep))


def air_feed(spark: SparkSession, d: str) -> DataFrame:
    """One station feed response per event: ``(event_id, raw)``."""
    a = A.air_raw(spark, d, with_event_id=True).withColumn("user_id", F.expr("cast(substring(station_id, 2) as bigint)"))
    eid = F.col("event_id")
    iaqi = F.struct(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))).alias(k) for k, c in [
        ("pm25", "pm25"), ("pm10", "pm10"), ("no2", "no2"), ("o3", "o3"), ("t", "temperature_c"),
        ("h", "humidity_pct"), ("p", "pressure_hpa")]])
    aqi = (F.when(F.col("aqi").isNull(), var(F.lit("-")))
           .when(eid % 2 == 0, var(F.col("aqi"))).otherwise(var(F.col("aqi").cast("string"))))
    city = F.struct(F.when(eid % 41 != 0, F.array(F.col("latitude"), F.col("longitude"))).alias("geo"),
                    F.col("station_name").alias("name"))
    attributions = F.when(F.col("attribution").isNotNull(),
                          F.array(F.struct(F.lit("https://example.org").alias("url"), F.col("attribution").alias("name")),
                                  F.struct(F.lit("https://example.org/w").alias("url"), F.lit("World AQ").alias("name"))))
    data = F.struct(aqi.alias("aqi"), F.col("user_id").alias("idx"), attributions.alias("attributions"), city.alias("city"),
                    iaqi.alias("iaqi"), F.struct(_iso(F.col("measured_at"), "+00:00").alias("iso")).alias("time"))
    doc = F.struct(F.when(eid % 50 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"), data.alias("data"))
    return with_barrier(a.select("event_id", F.to_json(doc).alias("raw")))


def weather_feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(forecast, air-quality) responses per event, keyed by point and fetch id.
    Every 7th fetch has no air-quality response."""
    w = A.weather_raw(spark, d, with_event_id=True)
    eid = F.col("event_id")
    cur = F.struct(
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.lit(900).alias("interval"),
        F.col("temperature_c").alias("temperature_2m"), F.col("humidity_pct").alias("relative_humidity_2m"),
        F.col("apparent_temperature_c").alias("apparent_temperature"),
        F.col("is_day").cast("int").alias("is_day"), F.col("precipitation_mm").alias("precipitation"),
        F.col("rain_mm").alias("rain"), F.col("snowfall_cm").alias("snowfall"),
        F.col("weather_code").cast("int").alias("weather_code"), F.col("wind_speed_ms").alias("wind_speed_10m"))
    fc = F.struct(F.col("latitude"), F.col("longitude"), F.lit(0).alias("utc_offset_seconds"),
                  F.lit("GMT").alias("timezone"), cur.alias("current"))
    forecast = with_barrier(w.select("point_id", F.col("event_id").alias("fetch_id"), "point_name",
                                     F.to_json(fc).alias("raw")))
    aq = F.struct(F.struct(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm").alias("time"),
                           F.col("uv_index"), F.lit(None).cast("double").alias("pm2_5")).alias("current"))
    air = w.filter(eid % 7 != 0).select("point_id", F.col("event_id").alias("fetch_id"), F.to_json(aq).alias("raw"))
    return forecast, air


def line_pages(spark: SparkSession, d: str) -> DataFrame:
    """Line reference pages of 100 records (``page_offset``, raw); every 50th
    line is repeated on the next page with other attributes; every 97th
    record has no id."""
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    rec = F.struct(F.when(k % 97 != 0, F.concat(F.lit("C"), k.cast("string"))).otherwise(F.lit("")).alias("id_line"),
                   F.col("p_brand").alias("shortname_line"), F.col("p_name").alias("name_line"),
                   F.lower("p_type").alias("transportmode"), F.lit(None).cast("string").alias("transportsubmode"),
                   F.lit("").alias("networkname"), F.lit("RATP").alias("operatorname"),
                   F.concat(F.when(k % 2 == 0, F.lit(" #")).otherwise(F.lit("")),
                            F.substring(F.md5(F.col("p_name")), 1, 6)).alias("colourweb_hexa"),
                   F.when(k % 3 == 0, F.lit("fff")).otherwise(F.lit("FFFFFF")).alias("textcolourweb_hexa"),
                   F.lit("active").alias("status"), F.lit(None).cast("string").alias("accessibility"))
    nul = F.lit(None).cast("string")
    dup = F.struct(F.concat(F.lit("C"), k.cast("string")).alias("id_line"), F.lit("DUP").alias("shortname_line"),
                   *[nul.alias(c) for c in ("name_line", "transportmode", "transportsubmode", "networkname",
                                            "operatorname", "colourweb_hexa", "textcolourweb_hexa", "status",
                                            "accessibility")])
    rows = (p.select((k.cast("long") / 100).cast("long").alias("page"), k.alias("pos"), rec.alias("r"))
            .unionByName(p.filter(k % 50 == 0).select(((k / 100).cast("long") + 1).alias("page"), k.alias("pos"),
                                                     dup.alias("r"))))
    # a page holds at most 100 + 2 records: grouping by page is bounded
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("l"))
    return pages.select((F.col("page") * 100).alias("page_offset"),
                        F.to_json(F.struct(F.lit(-1).alias("total_count"),
                                           F.transform("l", lambda x: x["r"]).alias("results"))).alias("raw"))


def station_listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(listing entries, per-station feeds) from the supplier table."""
    s = A.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    lat = F.lit(48.3) + (k * 7919 % 1100).cast("double") / F.lit(1000.0)
    lon = F.lit(1.6) + (k * 104729 % 1700).cast("double") / F.lit(1000.0)
    listing = s.select(F.to_json(F.struct(k.alias("uid"), lat.alias("lat"), lon.alias("lon"))).alias("raw"))
    aqi = F.when(F.col("s_acctbal") < 0, var(F.lit("-"))).otherwise(var((F.abs(F.col("s_acctbal")) % 300).cast("int")))
    data = F.struct(aqi.alias("aqi"), F.struct(F.array(lat, lon).alias("geo"), F.col("s_name").alias("name")).alias("city"),
                    F.when(k % 4 != 0, F.array(F.struct(F.lit("Airparif").alias("name")))).alias("attributions"))
    feeds = s.select(k.cast("string").alias("uid"),
                     F.to_json(F.struct(F.when(k % 13 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                                        data.alias("data"))).alias("raw"))
    return listing, feeds


def journey_specs(spark: SparkSession, d: str) -> DataFrame:
    """One ``id:label:lat,lon:lat,lon`` spec per order; every 53rd has one
    point only, every 59th a malformed point."""
    o = A.table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    p1 = F.concat((F.lit(48.0) + (k * 6007 % 2000).cast("double") / 1000.0).cast("string"), F.lit(","),
                  (F.lit(1.5) + (k * 7001 % 2000).cast("double") / 1000.0).cast("string"))
    p2 = F.concat((F.lit(48.0) + (k * 3001 % 2000).cast("double") / 1000.0).cast("string"), F.lit(","),
                  (F.lit(1.5) + (k * 9001 % 2000).cast("double") / 1000.0).cast("string"))
    head = F.concat(F.lit("O"), k.cast("string"), F.lit(":Commande "), k.cast("string"))
    spec = (F.when(k % 53 == 0, F.concat_ws(":", head, p1))
            .when(k % 59 == 0, F.concat_ws(":", head, p1, F.lit("x,y")))
            .otherwise(F.concat_ws(":", head, p1, p2)))
    return o.select(spec.alias("spec"))
