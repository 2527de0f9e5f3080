"""Operators for large training-data pipelines.

Every operator takes and returns DataFrames and has its own general interface;
``queries`` holds the thin registered queries built on them.
"""
