"""Operators for large text corpora (training-data preparation).

Nothing outside this package imports it.  Every module holds one operator
with a general interface; :mod:`annospark.llm.queries` has the thin
``opN_<name>`` queries over the standard tables.
"""
