"""Snippets that mark what a query looks for."""

from __future__ import annotations

from pyspark.sql import Column

from inkwell.functions.snippet import MAX_KEYWORDS, snippet
from inkwell.plans import qparse as Q


def query_snippet(c: Column, query: Q.Query | str, tags: list[tuple[str, str]], width: int = 100, max_results: int = 3, **how: bool) -> Column:
    """Snippets around the operands of a query that aren't excluded; the tags are taken in turn. Operands wider than a snippet are left out."""
    if isinstance(query, str):
        query = Q.parse(query)
    words = [w for w in query.keywords() if len(w.encode()) <= width][:MAX_KEYWORDS]
    return snippet(c, [(w, *tags[i % len(tags)]) for i, w in enumerate(words)], width, max_results, **how)
