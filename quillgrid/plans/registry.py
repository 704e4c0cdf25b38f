"""All queries of the markup operators: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from quillgrid.plans import block_queries, inline_queries, lint_queries, more_queries, nested_queries, page_queries, reference_queries, render_queries, source_queries
from quillgrid.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "block_queries", "inline_queries", "lint_queries", "more_queries", "nested_queries", "page_queries", "reference_queries", "render_queries", "source_queries"]
