"""Column -> Column functions (no Python UDF): domain scalars of the engine."""

from metroscope.functions.geo import haversine_km, in_bbox  # noqa: F401
from metroscope.functions.scores import (  # noqa: F401
    aggregate_scores, grade, pollution_score, step_score, traffic_score, weather_score,
)
