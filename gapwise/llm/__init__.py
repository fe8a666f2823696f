"""Operators for preparing large text corpora for model training.

Every operator takes and returns Spark DataFrames. ``queries`` in
``gapwise.llm.catalog`` binds each of them to the driver's tables.
"""
