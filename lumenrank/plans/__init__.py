"""Queries: operators applied to tables, each with SQL that says what it must return."""
