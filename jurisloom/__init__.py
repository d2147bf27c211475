"""Jurisloom: a PySpark-native engine for versioned legal corpora.

Operators are pure functions from DataFrames to DataFrames.  Nothing here owns
a global session; callers pass the session (or frames) in.
"""

__version__ = "0.1.0"
