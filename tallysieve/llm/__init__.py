"""Operators for preparing large text corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
