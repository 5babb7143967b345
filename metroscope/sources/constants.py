"""S7: small inline reference tables (stops, stations, weather points, zones)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Monitored stop areas.
DEFAULT_STOPS = ["STIF:StopArea:SP:71517:", "STIF:StopArea:SP:42587:", "STIF:StopArea:SP:71264:",
                 "STIF:StopArea:SP:43135:", "STIF:StopArea:SP:43136:", "STIF:StopArea:SP:43122:",
                 "STIF:StopArea:SP:43124:", "STIF:StopArea:SP:71061:", "STIF:StopArea:SP:43185:",
                 "STIF:StopArea:SP:411160:"]
# Air stations polled.
DEFAULT_AIR_STATIONS = ["@5722", "@12763", "@3082", "@3097", "@3085", "@3099", "@3103", "@3104"]
# Weather points (id, name, lat, lon).
DEFAULT_WEATHER_POINTS = [
    ("paris-centre", "Paris centre (Châtelet)", 48.8566, 2.3522),
    ("la-defense", "La Défense", 48.8918, 2.2389),
    ("saint-denis", "Saint-Denis", 48.9362, 2.3574),
    ("versailles", "Versailles", 48.8044, 2.1232),
    ("creteil", "Créteil", 48.7800, 2.4655),
    ("boulogne", "Boulogne-Billancourt", 48.8350, 2.2410),
    ("vitry", "Vitry-sur-Seine", 48.7872, 2.4023),
    ("argenteuil", "Argenteuil", 48.9472, 2.2498),
    ("cergy", "Cergy (grande couronne O)", 49.0388, 2.0780),
    ("melun", "Melun (grande couronne SE)", 48.5403, 2.6605),
]
# Named zones of the score page (name, lat, lon).
PREDEFINED_ZONES = [
    ("Châtelet (Paris 1er)", 48.8585, 2.3470), ("La Défense", 48.8918, 2.2389), ("Gare du Nord", 48.8809, 2.3553),
    ("Saint-Lazare", 48.8754, 2.3253), ("Gare de Lyon", 48.8447, 2.3736), ("Montparnasse", 48.8413, 2.3210),
    ("Versailles", 48.8014, 2.1301), ("Saint-Denis", 48.9358, 2.3539), ("Boulogne-Billancourt", 48.8347, 2.2400),
    ("Créteil", 48.7910, 2.4634),
]


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDEFINED_ZONES, "zone string, latitude double, longitude double")


def weather_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_WEATHER_POINTS, "point_id string, point_name string, latitude double, longitude double")


def stops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in DEFAULT_STOPS], "stop_id string")


def air_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in DEFAULT_AIR_STATIONS], "station_id string")
