"""All queries of this package's own operators, and their SQL."""

from __future__ import annotations

from lumenrank.plans import grouping, pixels, replies, reporting, scores, settings, stages, subjects

_PARTS = (reporting, scores, grouping, pixels, subjects, replies, settings, stages)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
