"""Training-data operators: dedup, packing, scoring, decontamination, token files.

Nothing else in the library imports this subpackage.
"""
