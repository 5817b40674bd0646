"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage; ``queries`` and ``oracle_sql`` are its entry.
"""

from millrace.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
