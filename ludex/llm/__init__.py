"""Operators of a training-data pipeline over the corpus tables.

Nothing outside this package imports it; ``ludex.llm.queries`` holds the
registered queries, ``corpus_pipeline.py`` at the repository top chains five
of the operators.
"""
