"""Queries over raw text, without an index: columns only, one pass, no join."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.plans import qparse as Q


def _folded(c: Column, normalize: bool) -> Column:
    """Text without blanks, normalised if asked."""
    if normalize:
        c = T.normalize_text(c, remove_blank=True)
    return F.regexp_replace(c, T.SPACE, "")


def occurrences(c: Column, keyword: str) -> Column:
    """How often a keyword occurs, overlaps included."""
    return F.regexp_count(c, F.lit(f"(?={re.escape(keyword)})")) if len(keyword) > 1 else F.length(c) - F.length(F.replace(c, F.lit(keyword), F.lit("")))


def _fold(query: Q.Query, group: Q.Group, c: Column, section: int, normalize: bool) -> tuple[Column, Column]:
    found, score = F.lit(False), F.lit(0)
    for step in query.steps(group):
        if isinstance(step.node, Q.Group):
            f, s = _fold(query, step.node, c, section, normalize)
        else:
            word = "".join(T.normalize_with_offsets(step.node.text, True, raw=not normalize)[0])
            tf = occurrences(c, word) if word else F.lit(0)
            weight = query.weights.get(section, 0) if query.weights is not None else step.weight or 1
            f, s = tf > 0, tf * F.lit(weight)
        if step.op == Q.OR:
            found, score = found | f, score + s
        elif step.op == Q.AND:
            found, score = found & f, score + s
        elif step.op == Q.BUT:
            found = found & ~f
        else:
            score = score + s
    return found, score


def scan(query: Q.Query | str, columns: list[Column], normalize: bool = False) -> tuple[Column, Column]:
    """(found, score) of a query over texts that are sections 1, 2, ...; null texts find nothing."""
    if isinstance(query, str):
        query = Q.parse(query)
    found, score = F.lit(False), F.lit(0)
    for i, c in enumerate(columns):
        f, s = _fold(query, query.root, _folded(F.coalesce(c, F.lit("")), normalize), i + 1, normalize)
        found, score = found | f, score + s
    return found, score.cast("long")
