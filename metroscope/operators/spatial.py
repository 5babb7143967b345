"""Nearest-sensor matching and radius search by great-circle distance.

``nearest`` keeps every point (left-join semantics) and attaches the closest
sensor; ties on distance go to the smallest sensor id, which is the first
candidate of the reference's id-ordered snapshot.  Three exact strategies:

* ``scan``  - few sensors (count checked against ``SCAN_MAX_SENSORS``): the
  sensor list is a scalar subquery (evaluated once, a few KB) and each point
  takes ``array_min`` over the distances; no join, no shuffle.  When the caller
  asks for a scan of more sensors, NumPy compares all pairs in blocks and the
  distance formula decides among the sensors left.
* ``cells`` - up to ``INDEX_MAX_SENSORS`` locations: cells are cut into 4 x 4
  until at most ``LEAF_CANDIDATES`` sensors can be the nearest one
  of some point in the cell, however dense or empty the region around it; the
  leaves cover the globe and each lists those sensors.  The leaf table is built
  once, stored, its bytes checked, and broadcast once; a point belongs to
  exactly one leaf, found by an equi-join on (level, cell), and compares the
  leaf's candidates.  Points never move and are never aggregated.
* ``grid``  - any number of sensors: points and sensors get cells of a
  lat/lon grid; a point is equi-joined with the sensors of its 3x3 cell
  block and keeps the best candidate when it is provably closer than
  anything outside the block.  Points left over go to a grid with cells
  eight times as large, until one cell spans the globe.  When the replicated
  sensors of all levels keep a checked row bound, each level is a broadcast
  table of cells with their sensor lists, and points never move.  Otherwise a
  level's sensor side is broadcast only under that bound, and the join shuffles
  on the cell beyond it (AQE splits cells that are hot on the point side);
  each such level's output is checkpointed to the shared checkpoint folder, so
  lineage stays short and a lost executor recomputes one level only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metroscope.functions.geo import EARTH_RADIUS_KM, haversine_km
from metroscope.operators.common import materialize, planned_partitions, spread
from metroscope.session import ensure_checkpoint_dir

SCAN_FORCED_MAX_SENSORS = 10_000  # the same when the caller asks for it
SCAN_MAX_SENSORS = 32            # sensors carried in one scalar list (cost: S distances per point)
BROADCAST_MAX_CELL_ROWS = 2_000_000  # replicated sensor rows (9 per sensor) allowed in a broadcast
INDEX_MAX_SENSORS = 300_000      # sensor locations a leaf index is built for
INDEX_MAX_BYTES = 256 << 20      # of a broadcast leaf index
LEAF_CANDIDATES = 16             # sensors a leaf may list before it is split
# size of the first cells, parts a side is cut into (a power of two: sizes are exact), how often (30 degrees / 4**12 is about 20 cm)
ROOT_DEG, SPLIT, LEAF_LEVELS = 30.0, 4, 12
MIN_CELL_DEG, GLOBAL_CELL_DEG = 0.01, 120.0
RADIUS_BROADCAST_MAX_SENSORS = 1_000_000  # sensors a radius search broadcasts, each once
RADIUS_REACH = 2                 # cells to either side a point looks up: smaller cells have fewer sensors out of range
RADIUS_TASKS_PER_CORE = 4        # tasks the points of a radius search are dealt to, at least
CHORD_SLACK, CHORD_ROUNDING = 1e-9, 1e-13  # relative and absolute: chords nearer to the radius are decided by the distance formula


def _sensor_struct(sensors: DataFrame, sensor_id: str, lat: str, lon: str, payload: Sequence[str]) -> Column:
    return F.struct(F.col(sensor_id).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"),
                    *[F.col(c).alias(c) for c in payload])


def _with_closest(df: DataFrame, cands: str, out: str, plat: Column, plon: Column) -> DataFrame:
    """Add ``out = struct(d, s)``: the closest candidate of the array column
    ``cands`` (sorted by sensor id); NULL for an empty or NULL array.

    Only the distance runs inside the lambda, once per candidate (the
    distance array is its own projection, so it is not re-evaluated); the
    minimum and its first position (= smallest id among equal distances) are
    plain array functions compiled with the rest of the stage.
    """
    df = df.withColumn("__ds", F.transform(F.col(cands), lambda x: haversine_km(plat, plon, x["lat"], x["lon"])))
    dmin = F.array_min("__ds")
    best = F.when(dmin.isNotNull(), F.struct(dmin.alias("d"), F.element_at(
        F.col(cands), F.array_position("__ds", dmin).cast("int")).alias("s")))
    return df.withColumn(out, best).drop("__ds")


def _unpack(df: DataFrame, best: str, payload: Sequence[str], prefix: str) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != best],
        F.col(f"{best}.s.id").alias(f"{prefix}id"),
        F.col(f"{best}.d").alias(f"{prefix}distance_km"),
        *[F.col(f"{best}.s.{c}").alias(f"{prefix}{c}") for c in payload],
    )


def nearest(points: DataFrame, sensors: DataFrame, point_keys: Sequence[str], *,
            sensor_id: str = "sensor_id", lat: str = "latitude", lon: str = "longitude",
            point_lat: str = "latitude", point_lon: str = "longitude",
            payload: Sequence[str] = (), prefix: str = "nearest_",
            strategy: str = "auto", start_cell_deg: float | None = None) -> DataFrame:
    """Attach to every point its nearest sensor: ``{prefix}id``,
    ``{prefix}distance_km`` and ``{prefix}<payload col>`` (NULL when there is
    no sensor at all).  ``point_keys`` must identify a point."""
    if strategy not in ("auto", "scan", "cells", "grid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    points = spread(points)
    if strategy != "grid":
        located = _by_location(sensors, sensor_id, lat, lon, payload).orderBy("s.id").limit(INDEX_MAX_SENSORS + 1).toArrow()  # a bounded table
        if located.num_rows <= SCAN_MAX_SENSORS:
            return _nearest_scan(points, sensors, sensor_id, lat, lon, point_lat, point_lon, payload, prefix)
        if strategy == "scan" and located.num_rows <= SCAN_FORCED_MAX_SENSORS:
            return _nearest_blocks(points, located, point_lat, point_lon, payload, prefix)
        index = LeafIndex.build(points.sparkSession, located) if located.num_rows <= INDEX_MAX_SENSORS else None
        if index is not None and index.bytes <= INDEX_MAX_BYTES:
            return index.attach(points, point_lat, point_lon, payload, prefix)
    return _nearest_grid(points, sensors, point_keys, sensor_id, lat, lon, point_lat, point_lon, payload,
                         prefix, start_cell_deg)


def _by_location(sensors: DataFrame, sensor_id: str, lat: str, lon: str, payload: Sequence[str]) -> DataFrame:
    """One sensor struct ``s`` per location with finite coordinates: the smallest id wins every tie there."""
    far = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return (sensors.filter(~far(lat) & ~far(lon)).select(_sensor_struct(sensors, sensor_id, lat, lon, payload).alias("s"))
            .groupBy(F.col("s.lat").alias("__la"), F.col("s.lon").alias("__lo")).agg(F.min("s").alias("s")).select("s"))


def _nearest_scan(points, sensors, sensor_id, lat, lon, point_lat, point_lon, payload, prefix):
    cands = sensors.select(F.sort_array(F.collect_list(_sensor_struct(sensors, sensor_id, lat, lon, payload))).alias("c")).scalar()
    plat, plon = F.col(point_lat), F.col(point_lon)
    out = _with_closest(points.withColumn("__cands", cands), "__cands", "__best", plat, plon).drop("__cands")
    return _unpack(out, "__best", payload, prefix)


SCAN_BLOCK = 1 << 18  # (point, sensor) pairs compared at once


def closest_in_blocks(xyz: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
    """Per point the sensors whose chord equals the shortest but for rounding: every pair is compared, a block at a time.

    NaN points take the first sensor.
    """
    import numpy as np  # only in a scan's tasks
    step = max(1, SCAN_BLOCK // len(xyz))
    for i in range(0, len(points), step):
        cos = points[i:i + step] @ xyz.T
        cos[np.isnan(cos[:, 0])] = np.where(np.arange(len(xyz)) == 0, 1.0, -1.0)
        row, sensor = np.nonzero(cos >= cos.max(1, keepdims=True) - 1e-14)
        yield from np.split(sensor, np.searchsorted(row, np.arange(1, len(cos))))


def _nearest_blocks(points, located, point_lat, point_lon, payload, prefix):
    """Every point against every sensor location: NumPy leaves the few sensors that may be nearest, the distance formula decides."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type
    sensors = located.column("s").combine_chunks()
    held = points.sparkSession.sparkContext.broadcast(sensors)

    def candidates(lat, lon):
        import numpy as np
        s = held.value
        xyz = _unit(*(s.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lon")))
        with np.errstate(invalid="ignore"):
            found = list(closest_in_blocks(xyz, _unit(*(c.to_numpy(zero_copy_only=False).astype(float) for c in (lat, lon)))))
        size = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), s.take(pa.array(np.concatenate(found) if found else [], pa.int64())))

    plat, plon = F.col(point_lat).cast("double"), F.col(point_lon).cast("double")
    read = F.arrow_udf(candidates, T.ArrayType(from_arrow_type(sensors.type)), F.ArrowUDFType.SCALAR)
    out = _with_closest(points.withColumn("__cands", read(plat, plon)), "__cands", "__best", plat, plon).drop("__cands")
    return _unpack(out, "__best", payload, prefix)


# ---------------------------------------------------------------------------- grid strategy
LEVEL_GROWTH = 8  # each fallback level has cells this many times larger


def _tile(c: float) -> float:
    """Cell size that divides 360 exactly (<= c), so the cells that meet at
    the antimeridian are full cells and the neighbour relation is exact."""
    return 360.0 / math.ceil(360.0 / c)


def _cell_levels(start: float) -> list[float]:
    levels, c = [], start
    while c < GLOBAL_CELL_DEG:
        levels.append(_tile(c))
        c *= LEVEL_GROWTH
    levels.append(_tile(min(c, 360.0)))
    return levels


HOT_CELL_MAX_LOCATIONS = 64  # distinct sensor locations allowed in one start cell
MAX_HALVINGS = 16


def _sensor_stats(sensors: DataFrame, lat: str, lon: str) -> tuple[float, int]:
    """(start cell, sensor count).  The start cell is about 3/4 of the mean
    spacing, then halved while some cell holds more than
    ``HOT_CELL_MAX_LOCATIONS`` distinct locations, so a dense cluster does
    not give long candidate lists; sparse areas fall through to coarser
    levels instead.  All candidate sizes are checked in one small aggregate
    over the distinct sensor locations (one result row per size)."""
    locs = sensors.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    start, n = _choose_start_cell(locs, "lat", "lon")
    if n == 0:
        return start, n
    # occupancy of the densest cell for every candidate size, in one job
    sizes = [start / (2 ** k) for k in range(MAX_HALVINGS + 1)]
    lv = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(sizes)]))
    occ = (locs.distinct().select("lat", "lon", lv.alias("L"))
           .groupBy(F.col("L.k").alias("k"), F.floor((F.col("lat") + F.lit(90.0)) / F.col("L.c")).alias("y"),
                    F.floor((F.col("lon") + F.lit(180.0)) / F.col("L.c")).alias("x"))
           .count().groupBy("k").agg(F.max("count").alias("m")).collect())
    worst = {r["k"]: r["m"] for r in occ}
    for k, c in enumerate(sizes):
        start = c
        if worst.get(k, 0) <= HOT_CELL_MAX_LOCATIONS:
            break
    return start, n


# ---------------------------------------------------------------------------- leaf index
def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points on the unit sphere; the squared distance of two is four times the haversine term."""
    import numpy as np  # only where an index is built
    phi, lam = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], -1)


def _cell_size(level: int) -> float:
    return ROOT_DEG / SPLIT ** level


def _cell_ball(level: int, cy: int, cx: int) -> tuple[np.ndarray, float]:
    """Centre of a cell on the unit sphere, and a radius that covers the cell.

    Along a parallel the distance from the centre grows towards the cell's
    sides, and along a side it is greatest at one of its ends: the farthest
    point is a corner.  The small surplus covers rounding of cell numbers.
    """
    import numpy as np  # only where an index is built
    size = _cell_size(level)
    south, west = cy * size - 90.0, cx * size - 180.0
    centre = _unit(np.array(south + size / 2), np.array(west + size / 2))
    corners = _unit(np.array([south, south, south + size, south + size]), np.array([west, west + size, west, west + size]))
    return centre, float(np.sqrt(((corners - centre) ** 2).sum(1).max())) + 1e-9


def _possible(xyz: np.ndarray, cand: np.ndarray, centre: np.ndarray, radius: float, probes: int = 24) -> np.ndarray:
    """The sensors of ``cand`` that may be nearest to some point within ``radius`` of ``centre``.

    A sensor is out when another one is nearer everywhere in the ball, that
    is, when the plane halfway between them misses the ball on its side.  The
    sensors nearest to the centre are the ones compared with.  The margin
    keeps sensors whose distances differ by rounding only.
    """
    import numpy as np  # only where an index is built
    own = xyz[cand]
    d2 = ((own - centre) ** 2).sum(1)
    near = np.sqrt(d2) <= np.sqrt(d2.min()) + 2 * radius + 1e-12
    cand, own, d2 = cand[near], own[near], d2[near]
    out = np.zeros(len(cand), bool)
    for j in np.argsort(d2, kind="stable")[:probes].tolist():
        apart = np.sqrt(((own - own[j]) ** 2).sum(1))
        out |= d2 - d2[j] > 2 * radius * apart + 1e-14
    return cand[~out]


def leaves(xyz: np.ndarray, cy: int, cx: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(level, cy, cx, candidates) of the leaves that cover one root cell."""
    import numpy as np  # only where an index is built
    open_cells = [(0, cy, cx, np.arange(len(xyz)))]
    while open_cells:
        level, cy, cx, cand = open_cells.pop()
        cand = _possible(xyz, cand, *_cell_ball(level, cy, cx))
        if len(cand) <= LEAF_CANDIDATES or level == LEAF_LEVELS:
            yield level, cy, cx, cand
        else:
            open_cells += [(level + 1, SPLIT * cy + dy, SPLIT * cx + dx, cand) for dy in range(SPLIT) for dx in range(SPLIT)]


class LeafIndex:
    """Stored leaves of a bounded sensor table: ``__lv``, ``__iy``, ``__ix`` and ``__c``, the candidates sorted by id."""

    def __init__(self, table: DataFrame, levels: list[int], bytes_: int):
        self.table, self.levels, self.bytes = table, levels, bytes_

    @classmethod
    def build(cls, spark: SparkSession, located: pa.Table) -> LeafIndex:
        """``located`` holds a struct ``s`` (id, lat, lon, payload) per location, sorted by id."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_type
        sensors = located.column("s").combine_chunks()
        held = spark.sparkContext.broadcast(sensors)
        rows, cols = int(180 / ROOT_DEG), int(360 / ROOT_DEG)
        cell = spark.createDataFrame([], "__lv int, __iy long, __ix long").schema
        kind = from_arrow_type(sensors.type)
        schema = T.StructType([*cell.fields, T.StructField("__c", T.ArrayType(kind))])

        def run(batches: Iterator[pa.RecordBatch]):
            import numpy as np
            s = held.value
            xyz = _unit(*(s.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lon")))
            for b in batches:
                for root in b.column(0).to_pylist():
                    found = list(leaves(xyz, *divmod(root, cols)))
                    size = np.cumsum([0, *(len(x[3]) for x in found)])
                    every = s.take(pa.array(np.concatenate([x[3] for x in found])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in found], pa.int32()), *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2)),
                         pa.ListArray.from_arrays(pa.array(size, pa.int32()), every)], ["__lv", "__iy", "__ix", "__c"])

        roots = spark.range(0, rows * cols, 1, min(rows * cols, spark.sparkContext.defaultParallelism))
        table = materialize(roots.mapInArrow(run, schema))
        levels = table.groupBy("__lv").agg(F.sum(F.size("__c")).alias("n"), F.count(F.lit(1)).alias("cells")).collect()  # a row per level
        width = max(64, 2 * sensors.nbytes // max(1, len(sensors)))
        return cls(table, sorted(r["__lv"] for r in levels), sum(r["n"] * width + r["cells"] * 64 for r in levels))

    def attach(self, points: DataFrame, point_lat: str, point_lon: str, payload: Sequence[str], prefix: str) -> DataFrame:
        plat, plon = F.col(point_lat).cast("double"), F.col(point_lon).cast("double")
        # a latitude beyond a pole comes down on the other side
        over = F.abs(plat) > 90.0
        lat = F.when(over, F.degrees(F.asin(F.sin(F.radians(plat))))).otherwise(plat)
        lon = F.when(over & (F.cos(F.radians(plat)) < 0), plon + 180.0).otherwise(plon)
        valid = plat.isNotNull() & plon.isNotNull() & ~F.isnan(plat) & ~F.isnan(plon)
        keys = ", ".join(f"struct({lv} AS lv, least(floor((__la + 90D) / {size!r}D), {math.ceil(180.0 / size) - 1}L) AS y, "
                         f"pmod(floor((__lo + 180D) / {size!r}D), {math.ceil(360.0 / size)}L) AS x)" for lv, size in ((lv, _cell_size(lv)) for lv in self.levels))
        # the leaves cover the globe without overlap: of a point's cells exactly one is a leaf
        out = points.withColumns({"__ok": F.coalesce(valid, F.lit(False)), "__la": lat, "__lo": lon})
        out = out.withColumn("__p", F.explode(F.expr(f"IF(__ok, array({keys}), slice(array({keys}), 1, 1))")))
        same = (F.col("__p.lv") == F.col("__lv")) & (F.col("__p.y") == F.col("__iy")) & (F.col("__p.x") == F.col("__ix")) & F.col("__ok")
        # at most INDEX_MAX_BYTES, checked by the caller
        out = out.join(F.broadcast(self.table), same, "left").filter(F.col("__c").isNotNull() | ~F.col("__ok"))
        out = _with_closest(out, "__c", "__b", plat, plon)
        return _unpack(out.drop("__ok", "__la", "__lo", "__p", "__lv", "__iy", "__ix", "__c"), "__b", payload, prefix)


def _choose_start_cell(sensors: DataFrame, lat: str, lon: str) -> tuple[float, int]:
    """Start cell ~ 3/4 of the mean sensor spacing over the sensors' box (a
    3x3 block then holds about five candidates)."""
    st = sensors.agg(F.count(F.lit(1)).alias("n"), F.min(lat).alias("a"), F.max(lat).alias("b"),
                     F.min(lon).alias("c"), F.max(lon).alias("d")).first()
    n = st["n"] or 0
    if n == 0:
        return GLOBAL_CELL_DEG, 0
    area = max((st["b"] - st["a"]) * (st["d"] - st["c"]), (MIN_CELL_DEG / 1000) ** 2)
    return max(0.75 * math.sqrt(area / n), MIN_CELL_DEG / 1000), n


def _cell_y(latc: Column, c: float) -> Column:
    return F.floor((latc + F.lit(90.0)) / F.lit(c))


def _cell_x(lonc: Column, c: float) -> Column:
    return F.pmod(F.floor((lonc + F.lit(180.0)) / F.lit(c)), F.lit(math.ceil(360.0 / c)))


def _safe_radius_km(plat: Column, plon: Column, c: float) -> Column:
    """Lower bound of the distance from the point to anything outside its
    3x3 cell block (latitude band, and the two bounding meridians)."""
    deg = math.pi / 180.0
    cy = F.floor((plat + F.lit(90.0)) / F.lit(c))
    lat_lo = (cy - 1) * F.lit(c) - F.lit(90.0)
    lat_hi = (cy + 2) * F.lit(c) - F.lit(90.0)
    inf = F.lit(float("inf"))
    d_lo = F.when(lat_lo <= -90.0, inf).otherwise((plat - lat_lo) * F.lit(deg * EARTH_RADIUS_KM))
    d_hi = F.when(lat_hi >= 90.0, inf).otherwise((lat_hi - plat) * F.lit(deg * EARTH_RADIUS_KM))
    if 3 * c >= 360.0:
        d_lon = inf
    else:
        cx = F.floor((plon + F.lit(180.0)) / F.lit(c))
        west = plon - ((cx - 1) * F.lit(c) - F.lit(180.0))
        east = ((cx + 2) * F.lit(c) - F.lit(180.0)) - plon
        dl = F.least(west, east)
        cosphi = F.cos(F.radians(plat))
        to_meridian = F.asin(F.least(F.lit(1.0), cosphi * F.sin(F.radians(dl))))
        to_pole = F.lit(math.pi / 2) - F.radians(F.abs(plat))
        d_lon = F.when(dl <= 90.0, to_meridian).otherwise(to_pole) * F.lit(EARTH_RADIUS_KM)
    # conservative margin against rounding of the two distance formulas
    return F.least(d_lo, d_hi, d_lon) * F.lit(1.0 - 1e-9) - F.lit(1e-9)


def _replicated(sens: DataFrame, c: float) -> DataFrame:
    """Every sensor once for each cell of its 3x3 block."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    ncx = math.ceil(360.0 / c)
    rep = (sens.select("s", _cell_y(F.col("s.lat"), c).alias("cy0"), _cell_x(F.col("s.lon"), c).alias("cx0"))
           .select("s", F.explode(offsets).alias("o"), "cy0", "cx0")
           .select("s", (F.col("cy0") + F.col("o.dy")).alias("__cy"),
                   F.pmod(F.col("cx0") + F.col("o.dx"), F.lit(ncx)).alias("__cx")))
    # offsets wrap onto the same cell: keep one copy
    return rep.dropDuplicates(["__cy", "__cx", "s"]) if ncx < 3 else rep


def _through_levels(points: DataFrame, sens: DataFrame, levels: Sequence[float], point_lat: str, point_lon: str) -> DataFrame:
    """Points with ``__b``, when the replicated sensors of all levels together are few enough to broadcast.

    A cell's sensors are one list, so a point stays one row in its task: it
    looks up its cell level by level until the best sensor is provably the
    nearest, and nothing is shuffled, grouped or stored.
    """
    plat, plon = F.col(point_lat), F.col(point_lon)
    out = points.withColumn("__done", F.lit(None).cast(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("s", sens.schema["s"].dataType)])))
    for i, c in enumerate(levels):
        cells = (_replicated(sens, c).groupBy(F.col("__cy").alias("__y"), F.col("__cx").alias("__x"))
                 .agg(F.sort_array(F.collect_list("s")).alias("__c")))
        todo = F.col("__done").isNull()  # a point that is done has no cell any more
        out = out.withColumns({"__cy": F.when(todo, _cell_y(plat, c)), "__cx": F.when(todo, _cell_x(plon, c))})
        same = (F.col("__cy") == F.col("__y")) & (F.col("__cx") == F.col("__x"))
        out = _with_closest(out.join(F.broadcast(cells), same, "left").drop("__y", "__x"), "__c", "__b", plat, plon)
        settled = F.col("__b") if i == len(levels) - 1 else F.when(F.col("__b.d") <= _safe_radius_km(plat, plon, c), F.col("__b"))
        out = out.withColumn("__done", F.when(todo, settled).otherwise(F.col("__done"))).drop("__c", "__b", "__cy", "__cx")
    return out.withColumnRenamed("__done", "__b")


def _nearest_grid(points, sensors, point_keys, sensor_id, lat, lon, point_lat, point_lon, payload, prefix,
                  start_cell_deg):
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    # one copy per location (the smallest id wins every tie there), materialized once
    sens = (sensors.select(_sensor_struct(sensors, sensor_id, lat, lon, payload).alias("s"))
            .groupBy(F.col("s.lat").alias("__la"), F.col("s.lon").alias("__lo")).agg(F.min("s").alias("s"))
            .select("s").checkpoint(eager=True))
    start, n = _sensor_stats(sens.select("s.lat", "s.lon"), "lat", "lon")
    if start_cell_deg:
        start = start_cell_deg
    levels = _cell_levels(start)
    if 9 * n * len(levels) <= BROADCAST_MAX_CELL_ROWS:
        return _unpack(_through_levels(points, sens, levels, point_lat, point_lon), "__b", payload, prefix)

    pcols = list(points.columns)
    todo = points.select(F.struct(*[F.col(c) for c in pcols]).alias("__p"))
    plat, plon = F.col(f"__p.{point_lat}"), F.col(f"__p.{point_lon}")
    done: list[DataFrame] = []
    for i, c in enumerate(levels):
        last = i == len(levels) - 1
        rep = _replicated(sens, c)
        if 9 * n <= BROADCAST_MAX_CELL_ROWS:
            rep = F.broadcast(rep)
        keyed = todo.select("__p", _cell_y(plat, c).alias("__cy"), _cell_x(plon, c).alias("__cx"))
        cand = keyed.join(rep, ["__cy", "__cx"], "left")
        scored = cand.select("__p", F.when(F.col("s").isNotNull(), F.struct(
            haversine_km(plat, plon, F.col("s.lat"), F.col("s.lon")).alias("d"),
            F.col("s.id").alias("id"), F.col("s").alias("s"))).alias("__b"))
        best = (scored.groupBy(*[F.col(f"__p.{k}").alias(f"__k{j}") for j, k in enumerate(point_keys)])
                .agg(F.any_value("__p").alias("__p"), F.min("__b").alias("__b"))
                .select("__p", "__b"))
        if last:
            done.append(best)
            break
        best = best.withColumn("__ok", F.coalesce(F.col("__b.d") <= _safe_radius_km(plat, plon, c), F.lit(False)))
        best = best.checkpoint(eager=True)
        done.append(best.filter("__ok").drop("__ok"))
        todo = best.filter(~F.col("__ok")).select("__p")
        if todo.isEmpty():
            break
    out = reduce(lambda a, b: a.unionByName(b), done)
    out = out.select(*[F.col(f"__p.{c}").alias(c) for c in pcols], "__b")
    return _unpack(out, "__b", payload, prefix)


def _band_lon_width(band: Column, c: float, radius_km: float, reach: int) -> Column:
    """Longitude cell width (deg) for latitude band ``band`` such that two
    points within ``radius_km`` in bands band-reach..band+reach differ by at
    most ``reach`` cells: sin(dlon/2) <= sin(r/2R) / cos(max |lat|)."""
    lo = (band - reach) * F.lit(c) - F.lit(90.0)
    hi = (band + 1 + reach) * F.lit(c) - F.lit(90.0)
    phi_max = F.least(F.greatest(F.abs(lo), F.abs(hi)), F.lit(90.0))
    arg = F.lit(math.sin(radius_km / (2 * EARTH_RADIUS_KM))) / F.cos(F.radians(phi_max))
    width = F.degrees(F.lit(2.0) * F.asin(F.least(arg, F.lit(1.0)))) * F.lit(1.0001 / reach)
    return F.when(arg >= 1.0, F.lit(360.0)).otherwise(F.least(F.greatest(width, F.lit(MIN_CELL_DEG)), F.lit(360.0)))


def _lon_cells(band: Column, lonc: Column, c: float, radius_km: float, reach: int) -> tuple[Column, Column]:
    w = _band_lon_width(band, c, radius_km, reach)
    # whole cells around the circle, each at least w wide (no narrow cell at the antimeridian)
    n = F.floor(F.lit(360.0) / w)
    # fewer cells around the circle than a neighbourhood has: one cell holds every longitude
    n_eff = F.when(n < 2 * reach + 1, F.lit(1)).otherwise(n)
    width = F.lit(360.0) / n_eff
    return F.pmod(F.floor((lonc + F.lit(180.0)) / width), n_eff), n_eff


def _unit_columns(lat: Column, lon: Column) -> list[Column]:
    """The point as a vector of length one, and its latitude's cosine."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la), F.cos(la)]


def _finite(lat: str, lon: str) -> Column:
    number = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  (false for NaN, NULL for NULL)
    return number(lat) & number(lon)


def _band(lat: Column, c: float) -> Column:
    """Latitude band as an int: two of them make one long join key."""
    return F.least(F.greatest(_cell_y(lat, c), F.lit(-1 << 30)), F.lit(1 << 30)).cast("int")


def _own_cell(df: DataFrame, lat: str, lon: str, c: float, radius_km: float, reach: int, y: str, x: str) -> DataFrame:
    df = df.withColumn(y, _band(F.col(lat), c))
    return df.withColumn(x, _lon_cells(F.col(y), F.col(lon), c, radius_km, reach)[0].cast("int"))


def _cells_around(df: DataFrame, lat: str, lon: str, c: float, radius_km: float, reach: int, y: str, x: str) -> DataFrame:
    """Every row once for each cell that anything within the radius can lie in: ``reach`` bands and, in each band's own grid, cells to either side."""
    steps = range(-reach, reach + 1)
    band = _band(F.col(lat), c)
    df = df.select("*", F.explode(F.array(*[band + k for k in steps])).alias(y))
    cx, n = _lon_cells(F.col(y), F.col(lon), c, radius_km, reach)
    each = F.when(n == 1, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in steps]))
    df = df.withColumns({"__cx0": cx, "__n": n}).select("*", F.explode(each).alias("__dx"))
    return df.withColumn(x, F.pmod(F.col("__cx0") + F.col("__dx"), F.col("__n")).cast("int")).drop("__cx0", "__n", "__dx")


def within_radius(points: DataFrame, sensors: DataFrame, radius_km: float, *,
                  sensor_id: str = "sensor_id", lat: str = "latitude", lon: str = "longitude",
                  point_lat: str = "latitude", point_lon: str = "longitude",
                  payload: Sequence[str] = (), prefix: str = "s_") -> DataFrame:
    """All (point, sensor) pairs with distance <= ``radius_km`` (inclusive).

    A range join, exact: latitude bands one radius high and, per band,
    longitude cells wide enough for that band's latitude; a point meets the
    sensors of its 3x3 neighbourhood by an equi-join.  Up to
    ``RADIUS_BROADCAST_MAX_SENSORS`` sensors (counted) are broadcast once
    each, points look up the cells around theirs and are dealt evenly to tasks,
    however dense their region; a task takes them cell by cell, so a stretch of
    the result names few sensors.  Beyond that sensors are replicated nine
    times and the join shuffles on the cell.

    A candidate is decided by its chord (three differences of stored unit
    vectors); the haversine distance decides those whose chord is within
    rounding of the radius, and is computed for the pairs returned.  The pairs
    are the result: their number, and so the work, grows with points times
    sensors in range.  Output carries ``{prefix}id``, ``{prefix}distance_km``
    and the payload columns; order by distance where a listing is wanted.
    """
    values = [F.col(v).alias(f"__v{i}") for i, v in enumerate(payload)]
    sens = materialize(sensors.filter(_finite(lat, lon)).select(
        F.col(sensor_id).alias("__id"), F.col(lat).alias("__la"), F.col(lon).alias("__lo"), *values,
        *[u.alias(f"__s{k}") for k, u in enumerate(_unit_columns(F.col(lat), F.col(lon)))]).distinct())
    broadcast = sens.limit(RADIUS_BROADCAST_MAX_SENSORS + 1).count() <= RADIUS_BROADCAST_MAX_SENSORS
    pts = points.filter(_finite(point_lat, point_lon))
    reach = RADIUS_REACH if broadcast else 1
    grid = (max(radius_km / (EARTH_RADIUS_KM * math.pi / 180.0) / reach, MIN_CELL_DEG), radius_km, reach)
    if broadcast:
        tasks = max(planned_partitions(pts), RADIUS_TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism)
        pts = pts.repartition(tasks)  # round robin: a dense region is shared by all tasks
        # neighbours follow each other: they have nearly the same sensors in range, so a stored result names few at a time
        pts = _own_cell(pts, point_lat, point_lon, *grid, "__y", "__x").sortWithinPartitions("__y", "__x").drop("__y", "__x")
    pts = pts.withColumns({f"__p{k}": u for k, u in enumerate(_unit_columns(F.col(point_lat), F.col(point_lon)))})
    if broadcast:
        pts = _cells_around(pts, point_lat, point_lon, *grid, "__py", "__px")
        sens = F.broadcast(_own_cell(sens, "__la", "__lo", *grid, "__sy", "__sx"))
    else:
        pts = _own_cell(pts, point_lat, point_lon, *grid, "__py", "__px")
        sens = _cells_around(sens, "__la", "__lo", *grid, "__sy", "__sx")
    d = haversine_km(F.col(point_lat), F.col(point_lon), F.col("__la"), F.col("__lo"), F.col("__p3"), F.col("__s3"))
    half = 2.0 * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2))  # the radius as a chord
    chord2 = sum(((F.col(f"__p{k}") - F.col(f"__s{k}")) * (F.col(f"__p{k}") - F.col(f"__s{k}")) for k in (1, 2)),
                 (F.col("__p0") - F.col("__s0")) * (F.col("__p0") - F.col("__s0")))
    inside, outside = half * (1 - CHORD_SLACK) - CHORD_ROUNDING, half * (1 + CHORD_SLACK) + CHORD_ROUNDING
    near = (chord2 <= (inside * inside if inside > 0 else -1.0)) | ((chord2 <= outside * outside) & (d <= F.lit(radius_km)))
    pairs = pts.join(sens, (F.col("__py") == F.col("__sy")) & (F.col("__px") == F.col("__sx")) & near)
    return pairs.select(*points.columns, F.col("__id").alias(f"{prefix}id"), d.alias(f"{prefix}distance_km"),
                        *[F.col(f"__v{i}").alias(f"{prefix}{p}") for i, p in enumerate(payload)])
