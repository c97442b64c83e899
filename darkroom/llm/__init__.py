"""Operators for preparing language-model training corpora.

Nothing else in ``darkroom`` imports this subpackage.  Every operator takes and returns
DataFrames; :mod:`darkroom.llm.queries` binds them to the tables of a data directory.
"""
