"""DataFrame operators: snapshots, spatial joins, delay analytics, scoring, sinks."""
