"""Query trees to record sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.operators.index import TextIndex
from inkwell.operators.records import UNITS, Records
from inkwell.operators.select import select, token_plan
from inkwell.plans import qparse as Q


def _operand(index: TextIndex, step: Q.Step, query: Q.Query, stage: str, offset: int, unit: str) -> Records:
    mode = step.mode or stage
    if step.node.star and index.compat.prefix_star and mode == Q.EXACT:
        mode = Q.PREFIX
    # with section weights the operator's own weight doesn't count; a weight of 0 means none is given
    weight = dict(query.weights) if query.weights is not None else step.weight + offset or 1
    option = step.option if step.mode else None
    return select(
        index,
        step.node.text,
        mode,
        unit,
        weight,
        interval=10 if option is None else option,
        threshold=10 if option is None else option,
        policy=0 if option is None else option,
        expand=stage if mode == Q.SIMILAR else Q.EXACT,
    )


@dataclass
class _Set:
    """A record set as columns of one aggregated row per document."""

    here: Column
    score: Column
    n: Column


def _single_terms(index: TextIndex, query: Q.Query, group: Q.Group, offset: int) -> dict[tuple, None] | None:
    """The (term, weight) of each operand, if all are exact single terms; else None."""
    out: dict[tuple, None] = {}
    for step in query.steps(group):
        if isinstance(step.node, Q.Group):
            inner = _single_terms(index, query, step.node, offset)
            if inner is None:
                return None
            out |= inner
            continue
        if (step.mode or Q.EXACT) != Q.EXACT or (step.node.star and index.compat.prefix_star):
            return None
        plan = token_plan(index, step.node.text, Q.EXACT)
        if len(plan) != 1 or plan[0][0] != "exact":
            return None
        out[_leaf(index, query, step, offset)] = None
    return out


def _leaf(index: TextIndex, query: Q.Query, step: Q.Step, offset: int) -> tuple:
    term = token_plan(index, step.node.text, Q.EXACT)[0][1]
    return term, tuple(sorted(query.weights.items())) if query.weights is not None else step.weight + offset or 1


def _fold_columns(index: TextIndex, query: Q.Query, offset: int) -> Records | None:
    """The fold over exact single terms: postings are read once and aggregated once per document, operators are columns."""
    leaves = list(_single_terms(index, query, query.root, offset) or ())
    terms = sorted({t for t, _ in leaves})
    hit = index.postings.where(F.col("term").isin(terms))
    sets, aggs = {}, []
    for k, leaf in enumerate(leaves):
        term, weight = leaf
        if isinstance(weight, tuple):
            used = [(s, w) for s, w in weight if w]
            w = F.coalesce(*[F.when(F.col("sid") == s, F.lit(x)) for s, x in used]) if used else F.lit(None).cast("int")
        else:
            w = F.lit(weight)
        value = F.when(F.col("term") == term, (F.col("tf") + F.col("wsum")) * w)
        aggs += [F.sum(value).cast("long").alias(f"s{k}"), F.count(value).alias(f"n{k}")]
        sets[leaf] = _Set(F.col(f"n{k}") > 0, F.col(f"s{k}"), F.col(f"n{k}"))
    rows = hit.groupBy("rid").agg(*aggs)
    zero = lambda s, c: F.when(s.here, c).otherwise(F.lit(0).cast("long"))
    flags = 0

    def fold(group: Q.Group) -> _Set | None:
        nonlocal rows, flags
        out: _Set | None = None
        for step in query.steps(group):
            inside = isinstance(step.node, Q.Group)
            b = fold(step.node) if inside else sets[_leaf(index, query, step, offset)]
            if inside and (b is None or step.op == Q.ADJUST and out is not None):
                continue
            if out is None:
                out = b if step.op == Q.OR else None
                continue
            a = out
            if step.op == Q.BUT:
                out = _Set(a.here & ~b.here, a.score, a.n)
            elif not inside:
                score = zero(a, a.score) + zero(b, b.score)
                n = zero(a, a.n) if step.op == Q.ADJUST else zero(a, a.n) + zero(b, b.n)
                out = _Set({Q.OR: a.here | b.here, Q.AND: a.here & b.here, Q.ADJUST: a.here}[step.op], score, n)
            elif step.op == Q.OR:
                out = _Set(a.here | b.here, F.when(a.here, a.score).otherwise(b.score), F.when(a.here, a.n).otherwise(b.n))
            else:  # the smaller side's scores stay
                left = F.lit(True)
                if index.compat.intersect_keep_smaller:
                    flag, flags = f"left{flags}_", flags + 1
                    sizes = rows.agg((F.count_if(a.here) <= F.count_if(b.here)).alias(flag))
                    rows = rows.crossJoin(F.broadcast(sizes))  # one row
                    left = F.col(flag)
                out = _Set(a.here & b.here, F.when(left, a.score).otherwise(b.score), F.when(left, a.n).otherwise(b.n))
        return out

    got = fold(query.root)
    if got is None:
        return None
    return Records(rows.where(got.here).select("rid", got.score.alias("score"), got.n.alias("n_subrecs")), UNITS["document"], index.compat)


def _fold(index: TextIndex, query: Q.Query, group: Q.Group, stage: str, offset: int, unit: str) -> Records | None:
    out: Records | None = None
    for step in query.steps(group):
        if isinstance(step.node, Q.Group):
            inner = _fold(index, query, step.node, stage, offset, unit)
            if inner is None or step.op == Q.ADJUST and out is not None:
                continue
            if out is None:
                out = inner if step.op == Q.OR else None
            elif step.op == Q.OR:
                out = out.union(inner)
            elif step.op == Q.AND:
                out = out.intersect(inner)
            elif step.op == Q.BUT:
                out = out.subtract(inner)
            continue
        if out is None:
            if step.op == Q.OR:
                out = _operand(index, step, query, stage, offset, unit)
            continue
        out = out.accumulate(_operand(index, step, query, stage, offset, unit), step.op)
    return out


def execute(query: Q.Query, index: TextIndex, records: Records | None = None, op: str = Q.OR, unit: str = "document") -> Records:
    """Runs a query, relaxing it from exact to partial matches while too little is found.

    A threshold n >= 0 goes on while at most n records are found; a negative one
    names the stages: bits of -n are exact 1, unsplit 2, partial 4. A later
    stage weighs ``decay`` less and never changes the scores found before.
    ``records`` is a set to combine with.
    """
    n, offset, out, enough = query.threshold, 0, records, None
    for bit, stage in ((1, Q.EXACT), (2, Q.UNSPLIT), (4, Q.PARTIAL)):
        if stage != Q.EXACT:
            if n >= 0 and enough is None and out is not None:
                enough = out.df.limit(n + 1).count() > n or None
            wanted = not enough if n >= 0 else bool(-n & bit)
            if not wanted:
                continue
            offset -= query.decay
        elif n < 0 and not -n & bit:
            continue
        terms = _single_terms(index, query, query.root, offset) if stage == Q.EXACT and unit == "document" else None
        if terms and len(list(query.terms())) > 1:
            got = _fold_columns(index, query, offset)
        else:
            got = _fold(index, query, query.root, stage, offset, unit)
        if got is None:
            continue
        if out is None:
            out = got if op == Q.OR else None
        else:
            out = {Q.OR: out.union, Q.AND: out.intersect, Q.BUT: out.subtract}.get(op, lambda _: out)(got)
    return Records.empty(index.spark, unit, dict(index.postings.dtypes)["rid"], index.compat) if out is None else out


def search(index: TextIndex, text: str, default_op: str = Q.OR, unit: str = "document", records: Records | None = None, op: str = Q.OR) -> Records:
    """Parses and runs a query string."""
    return execute(Q.parse(text, default_op), index, records, op, unit)
