"""Operators over panels: windows, as-of joins, grids, splits, portfolios, metrics, inference, checks."""
