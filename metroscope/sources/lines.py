"""S4: line reference pages -> line dimension rows (first occurrence wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.functions.jsonvals import vget
from metroscope.functions.mobility import build_line_id, normalize_color
from metroscope.operators.snapshots import first_per_key

# Record members -> dimension columns (empty text -> NULL).
RECORD_COLUMNS = {
    "shortname_line": "short_name", "name_line": "long_name", "transportmode": "transport_mode",
    "transportsubmode": "transport_submode", "networkname": "network_name", "operatorname": "operator_name",
    "status": "status", "accessibility": "accessibility",
}


def scan_lines(pages: DataFrame, raw: str = "raw", page_order: str = "page_offset", dedupe: bool = True) -> DataFrame:
    """Explode ``results[]`` of every page; records without ``id_line`` are
    dropped; a repeated line id keeps its first record in (page, position)
    order."""
    v = F.try_parse_json(F.col(raw))
    recs = pages.select(page_order, F.posexplode(vget(v, "$.results", "array<variant>")).alias("rec_pos", "r"))

    def text(k):
        return F.nullif(vget("r", f"$.{k}", "string"), F.lit(""))

    rows = recs.select(
        page_order, "rec_pos",
        build_line_id(vget("r", "$.id_line", "string")).alias("line_id"),
        *[text(k).alias(c) for k, c in RECORD_COLUMNS.items()],
        normalize_color(vget("r", "$.colourweb_hexa", "string")).alias("color_web_hex"),
        normalize_color(vget("r", "$.textcolourweb_hexa", "string")).alias("text_color_hex"),
    ).filter(F.col("line_id").isNotNull())
    if dedupe:
        rows = first_per_key(rows, ["line_id"], [page_order, "rec_pos"])
    return rows

