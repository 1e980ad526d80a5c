"""Training-data operators on Spark: formatting, sharding, scanning, scoring,
near-duplicate grouping, token files, packing and decontamination.

Nothing else in the library imports this subpackage.
"""
