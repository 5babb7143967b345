"""Mentions, classifier replies, routing."""

from pyspark.sql import functions as F

from metroscope.functions import text as tx
from metroscope.operators import assistant


def test_zone_and_line_mentions(spark):
    qs = ["comment est l'air à Paris ?", "la pollution à la défense", "comment ça va ?", "comment est le RER A ?",
          "le rer b est il en retard ?", "la T2 marche bien ?", "comment va le métro 1 ?", "la ligne 14 est en panne ?"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [tuple(r) for r in df.select(tx.extract_zone("q"), tx.extract_line("q")).collect()]
    assert got == [("paris", None), ("défense", None), (None, None), (None, "RER A"), (None, "RER B"), (None, "T2"),
                   (None, "1"), (None, "14")]


def test_normalize_intent(spark):
    replies = ['```json\n{"intent": "weather", "language": "en"}```', '{"intent": "traffic", "language": "de"}',
               '{"intent": "nope"}', "not json", '  {"intent": "help", "language": "fr"}  ']
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    i, lang = tx.normalize_intent("r")
    assert [tuple(x) for x in df.select(i, lang).collect()] == [
        ("weather", "en"), ("traffic", "fr"), ("general_knowledge", "fr"), ("general_knowledge", "fr"), ("help", "fr")]


def test_route_tools_and_data_flag(spark):
    df = spark.createDataFrame([("greeting",), ("journey_score",), ("air_quality",)], "intent string")
    got = sorted((r.intent, r.tool or "") for r in assistant.route_tools(df).collect())
    assert got == [("air_quality", "get_current_air_quality"), ("greeting", ""),
                   ("journey_score", "get_current_air_quality"), ("journey_score", "guide_journey_commands")]
    ctx = spark.createDataFrame([(["[NO_DATA] x", "[DATA] y"],), (["[GUIDE] z"],)], "c array<string>")
    assert [r[0] for r in ctx.select(tx.has_real_data("c")).collect()] == [True, False]


def test_score10(spark):
    df = spark.createDataFrame([(20.0, 20.0), (26.0, 45.0), (100.0, 90.0), (250.0, 700.0)], "a double, d double")
    lo, hi = tx.air_score10("a")
    got = [tuple(r) for r in df.select(lo, hi, tx.air_advice10(lo), tx.traffic_score10("d")).collect()]
    assert [g[:2] for g in got] == [(9, 10), (7, 8), (4, 4), (1, 1)]
    assert [g[3] for g in got] == [10, 8, 6, 2]
    assert got[2][2] == "Limite les efforts physiques en extérieur."
