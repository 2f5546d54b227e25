"""Queries over the test tables and the SQL that each must equal."""

from __future__ import annotations


def all_queries():
    """(name -> query, name -> SQL) over every module of this package."""
    from fieldmark.checks import register
    from fieldmark.checks import q_features, q_matrix, q_quality, q_registry, q_scoring, q_serve, q_sources  # noqa: F401

    return dict(register.QUERIES), dict(register.ORACLES)
