"""Checkable queries, each next to the SQL that must give the same rows."""

from __future__ import annotations


def all_queries():
    """All registered queries and their SQL, in inventory order."""
    from barloom.suite import case, diagnostics, evaluation, learning, news, panel, serving, streams, tables, technical  # noqa: F401

    return case.QUERIES, case.SQL
