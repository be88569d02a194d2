"""Operators of a training-data pipeline, and the queries that apply them.

Nothing outside this package imports it except ``__spark_entry__.py``, which
adds ``queries.QUERIES`` and ``queries.ORACLE`` when the package is present,
and ``corpus_pipeline.py``.
"""
