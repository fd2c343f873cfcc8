"""Operators of a training-data pipeline: scoring, decontamination, deduplication, mixing, sharding and token output.

Nothing else in the library imports this subpackage.
"""
