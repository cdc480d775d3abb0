"""Operators of a training-data pipeline: one module per operator, queries in ``queries.py``.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
