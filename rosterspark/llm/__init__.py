"""Operators for training-data pipelines (packing, dedup, scoring, sharding, decontamination, PII, quality).

Nothing else in the package imports this subpackage.  Every module documents
its operator's method, its general interface and the defined results for
nulls, empty texts, ties, repeated rows, empty tables and extra columns.
"""
