"""S1: stop-monitoring responses -> stop visit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metroscope.operators.common import BARRIER_COL, barrier_holds, spread

from metroscope.functions import mobility as mb
from metroscope.functions.jsonvals import json_value, parse_iso_ts, plain_values, texts_are_plain


# Members of a visit -> names of the scan's columns.
VISIT = {"m_stop": "MonitoringRef", "m_recorded": "RecordedAtTime"}
JOURNEY = {"m_line": "LineRef", "m_vj": "FramedVehicleJourneyRef", "m_pub": "PublishedLineName", "m_note": "JourneyNote", "m_op": "OperatorRef",
           "m_dir": "DirectionName", "m_dest": "DestinationName", "m_mode": "VehicleMode"}
CALL = {"m_disp": "DestinationDisplay", "m_aa": "AimedArrivalTime", "m_ea": "ExpectedArrivalTime", "m_ad": "AimedDepartureTime",
        "m_ed": "ExpectedDepartureTime", "m_as": "ArrivalStatus", "m_ds": "DepartureStatus"}
DATED = "DatedVehicleJourneyRef"


def _members(journey_ref: str) -> dict[str, str]:
    """Column name -> path inside a visit."""
    out = VISIT | {k: f"MonitoredVehicleJourney.{m}" for k, m in JOURNEY.items()} | {k: f"MonitoredVehicleJourney.MonitoredCall.{m}" for k, m in CALL.items()}
    return out | ({"m_vj": f"{out['m_vj']}.{DATED}"} if journey_ref == "dated" else {})


def _schema(journey_ref: str, leaf: T.DataType) -> T.StructType:
    """The response with typed levels; the polymorphic members are read as ``leaf`` (VARIANT, or their JSON text), everything else is skipped by the parser."""
    def struct(members, **typed):
        return T.StructType([T.StructField(m, leaf) for m in members if m not in typed] + [T.StructField(m, t) for m, t in typed.items()])
    framed = {JOURNEY["m_vj"]: struct([DATED])} if journey_ref == "dated" else {}
    visit = struct(VISIT.values(), MonitoredVehicleJourney=struct(JOURNEY.values(), MonitoredCall=struct(CALL.values()), **framed))
    delivery = struct([], MonitoredStopVisit=T.ArrayType(visit))
    return struct([], Siri=struct([], ServiceDelivery=struct([], ResponseTimestamp=T.StringType(), StopMonitoringDelivery=T.ArrayType(delivery))))


def scan_stop_visits(bronze: DataFrame, raw: str = "raw", journey_ref: str = "reference",
                     keep: tuple[str, ...] = ("source_file",), with_rejects: bool = False):
    """Flatten ``Siri.ServiceDelivery.StopMonitoringDelivery[].MonitoredStopVisit[]``.

    Missing levels give zero rows.  ``recorded_at`` falls back to the
    response timestamp.  Visits without a stop or a line are rejected (the
    rest of the response continues).  ``journey_ref="reference"`` reads the
    journey id like the reference does (the framed reference object has no
    ``value``, so it is NULL); ``"dated"`` reads its dated journey reference.
    Output keeps ``keep`` columns plus ``delivery_pos`` / ``visit_pos`` for
    stable input order.
    """
    # The document is parsed once, with its levels typed and its members as JSON text; a second time, with its
    # members as VARIANT, only where a text does not tell what a member is.
    bronze = spread(bronze, barrier=True)
    keep = (*keep, *([BARRIER_COL] if BARRIER_COL in bronze.columns else []))
    members = _members(journey_ref)

    def read(j, values):
        """The texts of every visit's members, for every delivery."""
        each = lambda v: values(F.array(*[reduce(lambda x, m: x[m], path.split("."), v) for path in members.values()]))
        return F.transform(j["Siri"]["ServiceDelivery"]["StopMonitoringDelivery"], lambda d: F.transform(d["MonitoredStopVisit"], each))

    doc = bronze.select(*keep, F.col(raw).alias("__raw"), F.from_json(F.col(raw), _schema(journey_ref, T.StringType())).alias("j"))
    doc = doc.select(*keep, "__raw", F.coalesce(parse_iso_ts("j.Siri.ServiceDelivery.ResponseTimestamp"), F.current_timestamp()).alias("resp_ts"),
                     read(F.col("j"), plain_values).alias("read"))
    odd = F.exists("read", lambda d: F.exists(d, lambda v: F.exists(v, lambda x: x["odd"])))
    whole = F.from_json(F.col("__raw"), _schema(journey_ref, T.VariantType()))
    texts = (F.when(~texts_are_plain("__raw") | F.coalesce(odd, F.lit(False)), read(whole, lambda a: F.transform(a, json_value)))
             .otherwise(F.transform("read", lambda d: F.transform(d, lambda v: v["text"]))))
    base = doc.select(*keep, "resp_ts", F.posexplode(texts).alias("delivery_pos", "d"))
    ctx = [*keep, "resp_ts", "delivery_pos", "visit_pos"]
    vis = base.select(*keep, "resp_ts", "delivery_pos", F.posexplode("d").alias("visit_pos", "texts"))
    txt = vis.select(*ctx, *[F.col("texts")[i].alias(name[2:]) for i, name in enumerate(members)])
    op = mb.operator_name(F.col("op"))
    out = txt.select(
        *ctx,
        F.col("stop").alias("stop_id"), F.col("line").alias("line_id"), F.col("vj").alias("vehicle_journey_id"),
        mb.line_name(F.col("pub"), F.col("note"), F.col("line")).alias("line_name"),
        op.alias("operator"),
        F.coalesce("dir", "dest", "disp").alias("direction"),
        mb.infer_mode(F.col("mode"), F.col("line"), op).alias("transport_mode"),
        parse_iso_ts("aa").alias("aimed_arrival"), parse_iso_ts("ea").alias("expected_arrival"),
        parse_iso_ts("ad").alias("aimed_departure"), parse_iso_ts("ed").alias("expected_departure"),
        F.col("as").alias("arrival_status"), F.col("ds").alias("departure_status"),
        F.coalesce(parse_iso_ts("recorded"), F.col("resp_ts")).alias("recorded_at"),
        F.lit("prim").alias("source"),
    ).drop("resp_ts")
    valid = F.col("stop_id").isNotNull() & F.col("line_id").isNotNull() & barrier_holds(out)
    if with_rejects:
        return out.filter(valid).drop(BARRIER_COL), out.filter(~valid).drop(BARRIER_COL)
    return out.filter(valid).drop(BARRIER_COL)
