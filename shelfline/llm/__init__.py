"""Operators of a training-data pipeline over web-scale text corpora.

Each module holds one operator with a general interface; `queries.py`
registers one thin query per operator.  Nothing outside this package imports
it (``__spark_entry__.py`` adds its queries when it is present).
"""
