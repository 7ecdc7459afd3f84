"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``helixframe.llm.queries`` lists
the registered queries and their SQL.
"""
