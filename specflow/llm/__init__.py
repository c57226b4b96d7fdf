"""Operators of a training-data pipeline: scans, counts, joins, archives, packing."""
