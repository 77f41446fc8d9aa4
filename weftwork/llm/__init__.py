"""Operators for large training-data pipelines: tokens, near duplicates, scoring, mixing, media and archives.

Nothing outside this folder imports it. The queries are in queries.py, which __spark_entry__.py adds if it is here.
"""
