"""Operators that prepare text, pages and vectors for model training.

Nothing else in the library imports this package. The queries that apply its
operators to the test tables are in ``martlens.llm.queries``.
"""
