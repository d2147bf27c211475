"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Every module keeps a general
operator (frames in, frames out) and a thin query that fixes its parameters;
``queries`` and ``oracle_sql`` in :mod:`jurisloom.llm.registry` list them.
"""
