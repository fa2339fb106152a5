"""Selection: a text and a mode to scored records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.index import TextIndex
from inkwell.operators.lexicon import common_prefix_join
from inkwell.operators.records import UNITS, Records
from inkwell.sources.store import prepare_active


Weight = int | dict[int, int] | Callable[[Column, Column], Column]


def _cond(index: TextIndex, how: str, term: str) -> Column:
    """Which terms a query token stands for."""
    c = F.col("term")
    linked = index.linked_suffixes and term and ord(term[0]) >= 0x80
    if how == "prefix":
        return c.startswith(term)
    if how == "suffix":
        return c.endswith(term) if linked else c == term
    if how == "both":
        return c.contains(term) if linked else c.startswith(term)
    return c == term


def token_plan(index: TextIndex, text: str, mode: str) -> list[tuple[str, str, int]]:
    """(expansion, term, offset) of each query token."""
    if mode == "unsplit":
        whole = T.normalize(text, glue_controls=index.compat.glue_controls) if index.tokenizer.normalize else text
        return [("both", whole, 0)] if whole else []
    tokens, short = index.tokenizer.query_tokens(text)
    out = [["exact", t, p] for t, p in tokens]
    if not out:
        return []
    if mode == "partial" and len(out) == 1:
        out[0][0] = "both"
    else:
        if mode in ("prefix", "partial"):
            out[-1][0] = "prefix"
        if mode in ("suffix", "partial"):
            out[0][0] = "suffix"
    if short and out[-1][0] == "exact":
        out[-1][0] = "prefix"
    return [tuple(x) for x in out]


def _weighted(df: DataFrame, weight: Weight) -> DataFrame:
    """Adds the section's weight; sections that weigh nothing are left out."""
    if callable(weight):
        return df.withColumn("weight_", weight(F.col("rid"), F.col("sid"))).where("weight_ <> 0")
    if isinstance(weight, dict):
        used = {s: w for s, w in weight.items() if w}
        if not used:
            return df.where(F.lit(False)).withColumn("weight_", F.lit(0))
        w = reduce(lambda acc, kv: acc.when(F.col("sid") == kv[0], F.lit(kv[1])), list(used.items())[1:], F.when(F.col("sid") == next(iter(used)), F.lit(next(iter(used.values())))))
        return df.where(F.col("sid").isin(list(used))).withColumn("weight_", w)
    return df.withColumn("weight_", F.lit(weight or 1))


def _records(index: TextIndex, df: DataFrame, unit: str) -> Records:
    """Sums (rid, sid[, pos], score) to the unit; n_subrecs counts the sections (or occurrences) of a record."""
    keys = UNITS[unit]
    if unit == "section" or unit == "position":
        out = df.groupBy(*keys).agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("n_subrecs"))
    elif index.n_sections == 1:  # one section: its hits are the records already
        out = df.select("rid", F.col("score").cast("long").alias("score"), F.lit(1).cast("long").alias("n_subrecs"))
    else:
        out = df.groupBy("rid").agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("n_subrecs"))
    return Records(out, keys, index.compat)


def _tokens_hit(index: TextIndex, plan: list[tuple[str, str, int]]) -> DataFrame:
    """(rid, sid, tok, off, wsum, positions): postings with the number of the query token they serve. No join: the predicate is pushed to the scan."""
    conds = [_cond(index, how, term) for how, term, _ in plan]
    exact = sorted({t for how, t, _ in plan if how == "exact"})
    scan = F.col("term").isin(exact) if len(exact) and all(h == "exact" for h, _, _ in plan) else reduce(lambda a, b: a | b, conds)
    which = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("tok"), F.lit(off).alias("off"))) for i, (c, (_, _, off)) in enumerate(zip(conds, plan))]))
    return index.postings.where(scan).select("term", "rid", "sid", "tf", "wsum", "positions", F.explode(which).alias("t_")).select("term", "rid", "sid", "tf", "wsum", "positions", "t_.tok", "t_.off")


def select(index: TextIndex, text: str, mode: str = "exact", unit: str = "document", weight: Weight = 1, interval: int = 10, threshold: int = 10, policy: int = 0, expand: str = "exact", within: Records | None = None) -> Records:
    """Records of an index that match a text.

    exact: the term, or the phrase of several tokens. unsplit: the text as one
    term, or one that begins with it. partial, prefix, suffix: open ends. near:
    the tokens within ``interval`` of their places in the text (near2: of each
    other). similar: the ``threshold`` weightiest tokens. term_extract: see
    ``term_extract``. ``weight``: a number, a number per section (others
    count nothing), or a function of (rid, sid). ``within`` restricts the
    search to records of a set before anything is scored.
    """
    if mode == "similar":
        return similar(index, text, threshold, unit, weight, expand)
    if mode == "term_extract":
        return term_extract(index, text, policy, unit, weight)
    plan = token_plan(index, text, mode)
    if not plan:
        return _nothing(index, unit)
    hit = _tokens_hit(index, plan)
    if within is not None:
        hit = hit.join(within.df.select(*[c for c in within.unit if c != "pos"]).distinct(), [c for c in within.unit if c != "pos"], "left_semi")
    hit = _weighted(hit, weight)
    if mode in ("near", "near2"):
        return _records(index, _near(hit, len(plan), interval, mode == "near"), unit)
    if len(plan) == 1:
        if unit == "position":
            got = hit.select("rid", "sid", F.explode("positions").alias("pos"), ((F.col("wsum") + 1) * F.col("weight_")).alias("score"))
            return _records(index, got, unit)
        if plan[0][0] != "exact":
            if index.compat.first_posting_only:
                w = Window.partitionBy("rid", "sid").orderBy(F.col("positions")[0], "term")
                hit = hit.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1")
            else:
                hit = hit.groupBy("rid", "sid").agg(F.sum("tf").alias("tf"), F.sum("wsum").alias("wsum"), F.first("weight_").alias("weight_"))
        return _records(index, hit.select("rid", "sid", ((F.col("tf") + F.col("wsum")) * F.col("weight_")).alias("score")), unit)
    # phrase: all tokens at one aligned start, counted by aggregation whatever their number; partitioned by
    # document first, which serves all groupings (and joins with other operands) with one exchange
    place = hit.repartition("rid").select("rid", "sid", "tok", "wsum", "weight_", F.explode("positions").alias("p_"), "off").withColumn("pos", F.col("p_") - F.col("off"))
    if all(how == "exact" for how, _, _ in plan) and not index.compat.overlap_values:
        n_tokens = F.count("*")
    elif len(plan) < 64:
        n_tokens = F.bit_count(F.bit_or(F.expr("shiftleft(1L, tok)")))  # a distinct count without a second aggregation
    else:
        n_tokens = F.count_distinct("tok")
    start = place.groupBy("rid", "sid", "pos").agg(n_tokens.alias("n_"), F.sum("wsum").alias("w_"), F.first("weight_").alias("weight_")).where(F.col("n_") == len(plan))
    score = (F.col("w_") + 1) * F.col("weight_")
    if unit == "position":
        return _records(index, start.select("rid", "sid", "pos", score.alias("score")), unit)
    return _records(index, start.groupBy("rid", "sid").agg(F.sum(score).alias("score")), unit)


def _nothing(index: TextIndex, unit: str) -> Records:
    none = index.postings.where(F.lit(False)).select("rid", "sid", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("score"))
    return _records(index, none, unit)


def windows(positions: list[list[int]], interval: int) -> int:
    """How often all lists have an entry within ``interval``: after a hit the least entry jumps past the greatest, else into its reach."""
    at, n = [0] * len(positions), 0
    if any(not p for p in positions):
        return 0
    while True:
        now = [p[i] for p, i in zip(positions, at)]
        lo, hi = min(now), max(now)
        k = now.index(lo)
        if hi - lo <= interval:
            n += 1
            goal = hi + 1
        else:
            goal = hi - interval
        while at[k] < len(positions[k]) and positions[k][at[k]] < goal:
            at[k] += 1
        if at[k] == len(positions[k]):
            return n


def _near(hit: DataFrame, n: int, interval: int, aligned: bool) -> DataFrame:
    prepare_active()
    shift = F.col("off") if aligned else F.lit(0)
    lists = hit.withColumn("ps_", F.transform("positions", lambda p: p - shift))
    lists = lists.withColumn("ps_", F.filter("ps_", lambda p: p >= 0))
    tok = lists.repartition("rid").groupBy("rid", "sid", "tok").agg(F.flatten(F.collect_list("ps_")).alias("ps_"), F.first("weight_").alias("weight_"))
    every = tok.groupBy("rid", "sid").agg(F.collect_list(F.struct("tok", "ps_")).alias("all_"), F.first("weight_").alias("weight_")).where(F.size("all_") == n)

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: windows([sorted(set(r["ps_"])) for r in sorted(rows, key=lambda r: r["tok"])], interval)).astype("int32")

    return every.withColumn("n_", count("all_")).where("n_ > 0").select("rid", "sid", (F.col("n_") * F.col("weight_")).alias("score"))


def near_hits(index: TextIndex, text: str, interval: int = 10) -> DataFrame:
    """(rid, sid) in which all tokens stand within ``interval`` of each other: the relational form of near2, without counts."""
    plan = token_plan(index, text, "exact")
    place = _tokens_hit(index, plan).repartition("rid").select("rid", "sid", "tok", F.explode("positions").alias("pos"))
    w = Window.partitionBy("rid", "sid").orderBy("pos").rangeBetween(0, interval)
    seen = place.withColumn("toks_", F.collect_set("tok").over(w))
    return seen.where(F.size("toks_") == len(plan)).select("rid", "sid").distinct()


def similar(index: TextIndex, text: str, threshold: int = 10, unit: str = "document", weight: Weight = 1, expand: str = "exact") -> Records:
    """Documents that share the text's weightiest tokens.

    A token weighs its occurrences in the text plus 4 * documents div its
    document frequency; the ``threshold`` weightiest (0: an eighth of them, and
    one) are searched, ties by term.
    """
    tokens = index.tokenizer.tokens(text)
    count: dict[str, int] = {}
    for t, _ in tokens:
        count[t] = count.get(t, 0) + 1
    if not count:
        return _nothing(index, unit)
    spark = index.spark
    wanted = spark.createDataFrame(sorted(count.items()), "term string, n_ int")
    found = index.postings.where(F.col("term").isin(sorted(count)))
    n_docs = index.docs.agg(F.count("*").alias("docs_"))
    df = found.groupBy("term").agg(F.count_distinct("rid").alias("df_"))
    most = threshold or len(count) // 8 + 1
    top = df.join(F.broadcast(wanted), "term").crossJoin(n_docs).select("term", (F.col("n_") + F.expr("4 * docs_ div df_")).alias("w1_")).orderBy(F.desc("w1_"), "term").limit(most)
    if expand == "exact":
        hit = found.join(F.broadcast(top), "term")  # at most ``threshold`` rows
    else:
        how = {"unsplit": "prefix", "partial": "suffix"}[expand]
        rows = top.collect()
        conds = [(_cond(index, how, r.term), r.w1_) for r in rows]
        if not conds:
            return _nothing(index, unit)
        scan = reduce(lambda a, b: a | b, [c for c, _ in conds])
        w1 = reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in conds])
        hit = index.postings.where(scan).withColumn("w1_", w1)
    hit = _weighted(hit, weight)
    score = F.col("w1_") * F.col("weight_") * (F.col("tf") + F.col("wsum"))
    per_term = hit.groupBy("rid", "sid").agg(F.sum(score).alias("score"), F.count("*").alias("k_"))
    if unit == "document":
        out = per_term.groupBy("rid").agg(F.sum("score").cast("long").alias("score"), F.sum("k_").alias("n_subrecs"))
        return Records(out, UNITS[unit], index.compat)
    return Records(per_term.select("rid", "sid", F.col("score").cast("long").alias("score"), F.col("k_").alias("n_subrecs")), UNITS["section"], index.compat)


def term_extract(index: TextIndex, text: str, policy: int = 0, unit: str = "document", weight: Weight = 1) -> Records:
    """Documents of the terms that occur in a text.

    At each place the longest term that begins the rest of the text counts.
    Policy 0 goes on after it and gives a section record per document and place
    (sid: byte offset in the normalised text, score: offset + 1). Policy 1 goes
    on by one character and adds the weight per posting.
    """
    norm = T.normalize(text, glue_controls=index.compat.glue_controls) or ""
    spark = index.spark
    # the longest term at each place, by a join on the prefixes of what follows it
    begins = spark.createDataFrame([(i, norm[i:]) for i in range(len(norm))], "i int, rest string")
    got = common_prefix_join(begins, "rest", index.postings.select("term").distinct(), "term").where("found is not null").select("i", "found").collect() if norm else []
    longest = {r.i: r.found for r in got}
    places, i = [], 0
    while i < len(norm):
        best = longest.get(i)
        if best:
            places.append((best, len(norm[:i].encode())))
        i += len(best) if best and policy == 0 else 1
    if not places:
        return _nothing(index, "section" if policy == 0 else unit)
    at = F.broadcast(spark.createDataFrame(places, "term string, off_ int"))
    hit = index.postings.where(F.col("term").isin(sorted({t for t, _ in places}))).join(at, "term")
    if policy == 0:
        got = hit.select("rid", F.col("off_").alias("sid"), (F.col("off_") + 1).alias("score"))
        return Records(got.groupBy("rid", "sid").agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("n_subrecs")), UNITS["section"], index.compat)
    hit = _weighted(hit, weight)
    keys = UNITS[unit]
    return Records(hit.groupBy(*keys).agg(F.sum("weight_").cast("long").alias("score"), F.count("*").alias("n_subrecs")), keys, index.compat)


def sel(index: TextIndex, text: str, threshold: int = 0) -> Records:
    """Exact, then as a whole term, then by open ends, until more than ``threshold`` records are found."""
    out = select(index, text)
    for mode in ("unsplit", "partial"):
        if out.df.limit(threshold + 1).count() > threshold:
            break
        out = out.union(select(index, text, mode)) if mode == "partial" or threshold else select(index, text, mode)
    return out
