"""Registered queries: each module maps names to (query, SQL or None) in QUERIES."""

from __future__ import annotations


def modules() -> list:
    from . import checks, contracts, evidence, joins, results, shapes, sources, studies, windows

    return [windows, joins, shapes, studies, checks, contracts, evidence, sources, results]
