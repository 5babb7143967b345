"""metroscope — urban mobility and exposure analytics on Spark.

Bronze JSON feeds (stop monitoring, air stations, modelled weather, line
reference) become fact and dimension DataFrames; on top of them sit
latest-per-sensor snapshots, delay analytics, nearest-sensor matching and
the A–E journey health score.  Everything is expressed with DataFrame /
SQL column expressions; no Python UDF runs in a hot path.
"""

__version__ = "0.1.0"
