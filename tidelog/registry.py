"""The store's queries and their SQL, by name."""

from __future__ import annotations

from tidelog.queries import QUERIES, SQL

FLAGSHIP = "current_view"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
