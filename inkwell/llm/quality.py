"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Boosted regression trees are grown on a labelled sample; every path from a root
to a node is a conjunctive rule. A logistic regression with a lasso penalty
keeps the rules that matter, and those are compiled into one Spark column
expression, so all documents are scored inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import BROADCAST_ROWS

#: Labelled documents that training sees at most, taken by the hash of their id.
TRAIN_ROWS = 8000
TREES, DEPTH, SHRINK = 30, 3, 0.3
LEAST_LEAF = 5

STATS = ("n_words", "word_length", "distinct_share", "symbol_rate", "upper_rate", "digit_rate", "stop_rate", "line_rate")


def with_stats(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the STATS columns, named with ``prefix``; a null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    w = f"{prefix}words_"
    words = F.filter(F.split(t, "[ \n\r\t]+"), lambda x: x != "")
    n = F.greatest(F.size(F.col(w)), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    rate = lambda pattern, by: F.regexp_count(t, F.lit(pattern)).cast("double") / by
    stats = {
        "n_words": F.size(F.col(w)).cast("double"),
        "word_length": chars / n,
        "distinct_share": F.size(F.array_distinct(F.col(w))).cast("double") / n,
        "symbol_rate": rate(r"[#$%&*|!<>{}=_~^\\]", n),
        "upper_rate": rate(r"\p{Lu}", chars),
        "digit_rate": rate("[0-9]", chars),
        "stop_rate": rate("[.?]", n),
        "line_rate": rate("\n", n),
    }
    return docs.withColumn(w, words).withColumns({f"{prefix}{k}": v for k, v in stats.items()}).drop(w)


@dataclass
class Rule:
    """A conjunction of (statistic's number, above, cut)."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, cut in self.tests:
            ok &= (x[:, f] > cut) == above
        return ok

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for f, above, cut in self.tests:
            c = F.col(prefix + STATS[f])
            out = out & (c > F.lit(float(cut)) if above else c <= F.lit(float(cut)))
        return out


@dataclass
class Model:
    bias: float
    threshold: float
    rules: list[Rule] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return z

    def column(self, prefix: str = "") -> Column:
        """Probability of good quality."""
        z = F.lit(float(self.bias))
        for r in self.rules:
            z = z + F.when(r.column(prefix), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], tests: tuple, depth: int, rows: np.ndarray, out: list[Rule], step: np.ndarray) -> None:
    """Second-order boosting tree; appends each node's path to ``out`` and its leaf values to ``step``."""
    if tests:
        out.append(Rule(tests))
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            b = np.searchsorted(cuts[f], x[rows, f], side="left")  # x <= cut k for bins up to k
            n = len(cuts[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (gain[k], (f, cuts[f][k]))
    if best[1] is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    for side in (False, True):
        _grow(x, g, h, cuts, (*tests, (f, side, float(cut))), depth - 1, rows[above == side], out, step)


def _simplified(tests: tuple) -> tuple:
    """One test for each statistic and side."""
    kept: dict[tuple[int, bool], float] = {}
    for f, above, cut in tests:
        old = kept.get((f, above))
        kept[f, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple(sorted((f, a, c) for (f, a), c in kept.items()))


def _lasso(d: np.ndarray, y: np.ndarray, l1: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, k = d.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    v = np.random.default_rng(0).normal(size=k)
    for _ in range(20):
        v = d.T @ (d @ v)
        v /= np.linalg.norm(v) + 1e-12
    lip = 0.25 * (np.linalg.norm(d @ v) ** 2 / n + 1) + 1e-9
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(d @ vw + vb, -40, 40))) - y) / n
        nw = vw - d.T @ r / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - l1 / lip, 0)
        nb = vb - r.sum() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Trains on statistics and 0/1 labels; a quarter is held out to choose the penalty and the threshold. With one class only, all are good."""
    y = np.asarray(y, float)
    if len(y) < 8 or y.min() == y.max():
        return Model(4.0, 0.5)
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    if not held.any() or y[~held].min() == y[~held].max():
        held[:] = False
    tx, ty = x[~held], y[~held]
    vx, vy = (x[held], y[held]) if held.any() else (tx, ty)
    cuts = [np.unique(np.quantile(tx[:, f], np.linspace(0.005, 0.995, 100))) for f in range(x.shape[1])]
    z, rules = np.full(len(ty), np.log(ty.mean() / (1 - ty.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(ty))
        _grow(tx, p - ty, p * (1 - p), cuts, (), DEPTH, np.arange(len(ty)), rules, step)
        z += SHRINK * step
    unique = {}
    for tests in sorted({_simplified(r.tests) for r in rules}):
        hold = Rule(tests).holds(tx)
        if 0 < hold.sum() < len(tx):
            unique.setdefault(hold.tobytes(), tests)
    rules = [Rule(t) for t in unique.values()]
    if not rules:
        return Model(4.0, 0.5)
    d, dv = (np.stack([r.holds(s) for r in rules], 1).astype(float) for s in (tx, vx))
    best = None
    for l1 in (3e-2, 1e-2, 3e-3, 1e-3, 3e-4):
        w, b = _lasso(d, ty, l1)
        zv = dv @ w + b
        loss = np.mean(np.logaddexp(0, zv) - vy * zv)
        if best is None or loss < best[0] - 1e-4:
            best = (loss, w, b, zv)
    _, w, b, zv = best
    # threshold: best balanced accuracy on held-out rows, ties in favour of keeping
    grid = np.linspace(0.05, 0.5, 19)
    pv = 1 / (1 + np.exp(-zv))
    good, bad = max((vy == 1).sum(), 1), max((vy == 0).sum(), 1)
    score = [((pv >= t) & (vy == 1)).sum() / good + ((pv < t) & (vy == 0)).sum() / bad for t in grid]
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b), float(grid[int(np.argmax(score))]), [Rule(rules[k].tests, float(w[k])) for k in keep])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most TRAIN_ROWS labelled documents; only their statistics reach the driver. Null labels and ids aren't used."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label_")).where("doc_id is not null and label_ in (0, 1)").groupBy("doc_id").agg(F.max("label_").alias("label_"))
    picked = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    assert TRAIN_ROWS <= BROADCAST_ROWS
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_stats(text.join(F.broadcast(picked), "doc_id"), "text").select("doc_id", "label_", *STATS).distinct().toArrow().sort_by("doc_id")
    x = np.stack([rows[s].to_numpy() for s in STATS], 1) if rows.num_rows else np.empty((0, len(STATS)))
    return fit(x, rows["label_"].to_numpy())


def _free(columns: list[str]) -> str:
    p = "q_"
    while any(c.startswith(p) for c in columns):
        p = "q" + p
    return p


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score, accepted) of every row. A null or blank text scores 0 and is rejected; a null id is reported as null; repeated rows give equal rows. Other columns aren't read."""
    d = with_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "q_")
    score = F.when(F.col("q_n_words") > 0, model.column("q_")).otherwise(F.lit(0.0))
    return d.select("doc_id", score.alias("quality_score")).withColumn("accepted", F.col("quality_score") >= F.lit(model.threshold))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``scored`` accepts; columns unchanged, also those named like a statistic."""
    p = _free(docs.columns)
    d = with_stats(docs, "text", p)
    return d.where((F.col(f"{p}n_words") > 0) & (model.column(p) >= F.lit(model.threshold))).select(docs.columns)
