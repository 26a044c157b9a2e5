"""Training-data operators: packing, sharding, decontamination, quality, deduplication, scoring.

Each module holds one operator that takes and returns DataFrames. ``queries`` registers the
thin ``opN_<name>`` queries over them. Nothing outside this package imports it.
"""
