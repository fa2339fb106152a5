"""Registered queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import scalar as S
from inkwell.functions import text as T
from inkwell.functions.snippet import snippet
from inkwell.operators import lexicon
from inkwell.operators.index import TextIndex, fresh_path, postings, sections
from inkwell.operators.records import Records, merge
from inkwell.operators.select import near_hits, sel, select, similar, term_extract
from inkwell.operators.table import Catalog, Slot, Table
from inkwell.operators.tokenize import Tokenizer, delimited, run_rows, token_rows
from inkwell.plans import qparse as Q
from inkwell.plans.qcompile import search
from inkwell.plans.qscan import scan
from inkwell.plans.qsnippet import query_snippet
from inkwell.sources import tsv

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

SPLIT = r"'[ \f\n\r\t\x0B\x{3000}]+'"
TOK = f"""tok AS (SELECT doc_id AS rid, unnest(range(len(w))) AS pos, unnest(w) AS term FROM
 (SELECT doc_id, list_filter(regexp_split_to_array(text, {SPLIT}), lambda x: x <> '') AS w FROM documents))"""
TF = "tf AS (SELECT term, rid, count(*)::BIGINT AS tf, min(pos) AS first_pos FROM tok GROUP BY term, rid)"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        _ALL[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def index(spark: SparkSession, d: str) -> TextIndex:
    return TextIndex.of_columns(table(spark, d, "documents"), "doc_id", ["text"])


def _scores(r: Records, *more: str) -> DataFrame:
    return r.df.select(*r.unit, "score", *more)


def _found(s: SparkSession, d: str, text: str, **how: object) -> DataFrame:
    return _scores(search(index(s, d), text, **how))


# --- index and lexicon


@query(f"WITH {TOK} SELECT term, rid, 1 AS sid, count(*)::INTEGER AS tf, 0 AS wsum, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos FROM tok GROUP BY term, rid")
def idx_postings_delimited(s: SparkSession, d: str) -> DataFrame:
    p = postings(sections(table(s, d, "documents"), "doc_id", ["text"]), Tokenizer())
    return p.select("term", "rid", "sid", "tf", "wsum", F.col("positions")[0].cast("int").alias("first_pos"), F.element_at("positions", -1).cast("int").alias("last_pos"))


@query(f"WITH {TOK} SELECT term, count(DISTINCT rid)::BIGINT AS df, count(*)::BIGINT AS cf, length(term)::INTEGER AS n_chars FROM tok GROUP BY term")
def idx_lexicon_stats(s: SparkSession, d: str) -> DataFrame:
    return index(s, d).lexicon()


@query(f"WITH {TOK} SELECT count(DISTINCT (term, rid))::BIGINT AS postings, count(*)::BIGINT AS tokens, count(DISTINCT term)::BIGINT AS terms, (SELECT count(*) FROM documents WHERE text IS NOT NULL)::BIGINT AS documents FROM tok")
def idx_info(s: SparkSession, d: str) -> DataFrame:
    got = index(s, d).info()
    return s.createDataFrame([(got["postings"], got["tokens"], got["terms"], got["documents"])], "postings long, tokens long, terms long, documents long")


@query(f"""WITH {TOK}, t AS (SELECT DISTINCT term FROM tok) SELECT term FROM t WHERE starts_with(term, 'tho')""")
def lex_prefix(s: SparkSession, d: str) -> DataFrame:
    return lexicon.prefix_search(index(s, d).lexicon(), "tho", "term").select("term")


@query(f"""WITH {TOK}, t AS (SELECT DISTINCT term FROM tok) SELECT term FROM t WHERE suffix(term, 'é') AND EXISTS (SELECT 1 FROM t WHERE term = 'é')""")
def lex_suffix(s: SparkSession, d: str) -> DataFrame:
    return lexicon.suffix_search(index(s, d).lexicon().select("term"), "é", "term")


_TOKS = lambda t, i: f"(SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, {SPLIT}), lambda x: x <> '')) AS term FROM {t})"


@query(f"""WITH b AS {_TOKS("benchmark", 0)}, c AS {_TOKS("conversations", 0)}
SELECT b.term, arg_max(c.term, length(c.term)) AS found FROM b LEFT JOIN c ON starts_with(b.term, c.term) GROUP BY b.term""")
def lex_common_prefix(s: SparkSession, d: str) -> DataFrame:
    words = lambda t: table(s, d, t).select(F.explode(delimited(F.col("text"))).alias("t")).select(F.col("t.term").alias("term")).distinct()
    keys = words("conversations")
    return lexicon.common_prefix_join(words("benchmark"), "term", keys, "term").select("term", "found")


@query("SELECT row_number() OVER (ORDER BY p_name) AS id, p_name AS key FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)")
def lex_create(s: SparkSession, d: str) -> DataFrame:
    return lexicon.create(table(s, d, "part"), "p_name").select("id", "key")


# --- selection


@query(f"WITH {TOK} SELECT rid, count(*)::BIGINT AS score FROM tok WHERE term = 'the' GROUP BY rid")
def sel_exact_term(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "the"))


def _phrase_sql(words: list[str]) -> str:
    cond = " OR ".join(f"(term = '{w}' AND k = {i})" for i, w in enumerate(words))
    ks = ", ".join(f"({i})" for i in range(len(words)))
    return f"""WITH {TOK}, hit AS (SELECT rid, pos - k AS start, k FROM tok, (VALUES {ks}) v(k) WHERE {cond}),
st AS (SELECT rid, start FROM hit GROUP BY rid, start HAVING count(DISTINCT k) = {len(words)})
SELECT rid, count(*)::BIGINT AS score FROM st GROUP BY rid"""


@query(_phrase_sql(["of", "the"]))
def sel_phrase2(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "of the"))


@query(_phrase_sql(["the", "the", "the"]))
def sel_phrase3(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "the the the"))


@query(f"WITH {TOK}, {TF} SELECT rid, arg_min(tf, first_pos)::BIGINT AS score FROM tf WHERE starts_with(term, 'thi') GROUP BY rid")
def sel_prefix(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "thi", "prefix"))


@query(f"WITH {TOK}, {TF} SELECT rid, arg_min(tf, first_pos)::BIGINT AS score FROM tf WHERE suffix(term, 'éré') GROUP BY rid")
def sel_suffix(s: SparkSession, d: str) -> DataFrame:
    ix = TextIndex.build(sections(table(s, d, "documents"), "doc_id", ["text"]), linked_suffixes=True)
    return _scores(select(ix, "éré", "suffix"))


@query(f"WITH {TOK} SELECT rid, 1 AS sid, pos::BIGINT AS pos, 1::BIGINT AS score FROM tok WHERE term = 'der'")
def sel_position_unit(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "der", unit="position"))


@query(f"""WITH {TOK} SELECT DISTINCT a.rid, 1 AS sid FROM tok a JOIN tok b ON a.rid = b.rid AND abs(a.pos - b.pos) <= 3 WHERE a.term = 'the' AND b.term = 'of'""")
def sel_near_hits(s: SparkSession, d: str) -> DataFrame:
    return near_hits(index(s, d), "the of", 3)


@query()
def sel_near(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "the of", "near2", interval=3))


SIMILAR = "the of and to in la de der und die"


@query(f"""WITH {TOK}, {TF}, q AS (SELECT term, count(*) AS n FROM (SELECT unnest(string_split('{SIMILAR}', ' ')) AS term) GROUP BY term),
nd AS (SELECT count(*) AS docs FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, n + (4 * docs) // df AS w1 FROM q JOIN df USING (term), nd ORDER BY w1 DESC, term LIMIT 5)
SELECT rid, sum(w1 * tf)::BIGINT AS score, count(*)::BIGINT AS n_subrecs FROM tf JOIN w USING (term) GROUP BY rid""")
def sel_similar(s: SparkSession, d: str) -> DataFrame:
    return _scores(similar(index(s, d), SIMILAR, 5), "n_subrecs")


@query(f"""WITH {TOK}, {TF}, p AS (SELECT i FROM range(9) t(i)), txt AS (SELECT 'theandder' AS x),
best AS (SELECT i, max(length(term)) AS n FROM p, txt, (SELECT DISTINCT term FROM tf) l WHERE starts_with(substr(x, i + 1), term) GROUP BY i)
SELECT rid, count(*)::BIGINT AS score FROM best, txt JOIN tf ON TRUE WHERE tf.term = substr(x, best.i + 1, best.n) GROUP BY rid""")
def sel_term_extract(s: SparkSession, d: str) -> DataFrame:
    return _scores(term_extract(index(s, d), "theandder", policy=1))


@query(f"""WITH {TOK}, {TF}, m AS (SELECT max(length(term)) AS most FROM tf), txt AS (SELECT 'theandder' AS x),
best AS (SELECT i, max(length(term)) AS n FROM range(9) p(i), txt, (SELECT DISTINCT term FROM tf) l WHERE starts_with(substr(x, i + 1), term) GROUP BY i),
place AS (WITH RECURSIVE w(i) AS (SELECT 0::BIGINT UNION ALL SELECT w.i + coalesce((SELECT n FROM best WHERE best.i = w.i), 1) FROM w WHERE w.i < 9) SELECT w.i, n FROM w JOIN best USING (i))
SELECT rid, i::INTEGER AS sid, (i + 1)::BIGINT AS score FROM place, txt JOIN tf ON TRUE WHERE tf.term = substr(x, place.i + 1, place.n)""")
def sel_term_extract_places(s: SparkSession, d: str) -> DataFrame:
    return _scores(term_extract(index(s, d), "theandder", policy=0))


@query(f"WITH {TOK}, {TF} SELECT rid, arg_min(tf, first_pos)::BIGINT AS score FROM tf WHERE starts_with(term, 'thing') GROUP BY rid")
def sel_unsplit(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "thing", "unsplit"))


@query(f"WITH {TOK}, st AS (SELECT DISTINCT a.rid, a.pos FROM tok a JOIN tok b ON a.rid = b.rid AND b.pos = a.pos + 1 WHERE a.term = 'of' AND starts_with(b.term, 'th')) SELECT rid, count(*)::BIGINT AS score FROM st GROUP BY rid")
def sel_partial(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "of th", "partial"))


@query(f"WITH {TOK}, {TF} SELECT rid, arg_min(tf, first_pos)::BIGINT AS score FROM tf WHERE starts_with(term, 'thou') AND NOT EXISTS (SELECT 1 FROM tf WHERE term = 'thou') GROUP BY rid UNION ALL SELECT rid, tf FROM tf WHERE term = 'thou'")
def sel_staged(s: SparkSession, d: str) -> DataFrame:
    return _scores(sel(index(s, d), "thou"))


@query(f"WITH {TOK}, {TF} SELECT rid, (tf * (1 + rid % 3))::BIGINT AS score FROM tf WHERE term = 'the'")
def sel_weight_function(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(index(s, d), "the", weight=lambda rid, sid: 1 + rid % 3))


@query(f"WITH {TOK}, {TF} SELECT rid, (tf * 11)::BIGINT AS score FROM tf WHERE term = 'the'")
def sel_value_weights(s: SparkSession, d: str) -> DataFrame:
    ix = TextIndex.build(sections(table(s, d, "documents"), "doc_id", ["text"], weights=[10]))
    return _scores(select(ix, "the"))


@query(f"WITH {TOK}, {TF} SELECT rid, tf AS score FROM tf WHERE term = 'the' AND rid IN (SELECT rid FROM tf WHERE term = 'of')")
def sel_within(s: SparkSession, d: str) -> DataFrame:
    ix = index(s, d)
    return _scores(select(ix, "the", within=select(ix, "of")))


# --- over a saved index


def saved(s: SparkSession, d: str) -> TextIndex:
    return index(s, d).save(fresh_path(s))


@query(f"WITH {TOK} SELECT rid, count(*)::BIGINT AS score FROM tok WHERE term = 'the' GROUP BY rid")
def idx_saved_term(s: SparkSession, d: str) -> DataFrame:
    return _scores(select(saved(s, d), "the"))


_CHANGED = f"""x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'the new of text' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4),
tf AS (SELECT doc_id AS rid, len(list_filter(w, lambda t: t = 'the')) AS a, len(list_filter(w, lambda t: t = 'of')) AS b FROM (SELECT doc_id, regexp_split_to_array(text, {SPLIT}) AS w FROM x))"""


def _changed(s: SparkSession, d: str) -> TextIndex:
    docs = table(s, d, "documents")
    ix = saved(s, d).upsert(sections(docs.where("doc_id % 10 = 3").withColumn("text", F.lit("the new of text")), "doc_id", ["text"]))
    return ix.delete(docs.where("doc_id % 10 = 4").select(F.col("doc_id").alias("rid")))


@query(f"WITH {_CHANGED} SELECT rid, (5 * (a + b))::BIGINT AS score FROM tf WHERE a > 0 AND b > 0")
def idx_delta_query(s: SparkSession, d: str) -> DataFrame:
    return _scores(search(_changed(s, d), "+the +of"))


@query(f"WITH {_CHANGED} SELECT rid, (5 * a)::BIGINT AS score FROM tf WHERE a > 0 AND b = 0")
def idx_compacted_query(s: SparkSession, d: str) -> DataFrame:
    return _scores(search(_changed(s, d).compact(), "the -of"))


@query(f"WITH {TOK}, {TF} SELECT rid, tf AS score FROM tf WHERE term = 'the' AND rid % 7 <> 0")
def idx_logical_delete(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("rid"))
    return _scores(select(saved(s, d).mark_deleted(gone).compact(), "the"))


# --- query language; base weight 5


def _q(sql: str) -> str:
    terms = "".join(f", {n} AS (SELECT rid, tf FROM tf WHERE term = '{w}')" for n, w in (("t_the", "the"), ("t_of", "of"), ("t_and", "and"), ("t_to", "to")))
    return f"WITH {TOK}, {TF}{terms} {sql}"


@query(_q("SELECT rid, (5 * (coalesce(a.tf, 0) + coalesce(b.tf, 0)))::BIGINT AS score FROM t_the a FULL JOIN t_of b USING (rid)"))
def q_or(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "the of")


@query(_q("SELECT rid, (5 * (a.tf + b.tf))::BIGINT AS score FROM t_the a JOIN t_of b USING (rid)"))
def q_and(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "+the +of")


@query(_q("SELECT rid, (5 * tf)::BIGINT AS score FROM t_the WHERE rid NOT IN (SELECT rid FROM t_of)"))
def q_but(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "the -of")


@query(_q("SELECT rid, (5 * a.tf + 6 * coalesce(b.tf, 0))::BIGINT AS score FROM t_the a LEFT JOIN t_of b USING (rid)"))
def q_adjust(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "the >of")


@query(_q("SELECT rid, (5 * a.tf - coalesce(b.tf, 0))::BIGINT AS score FROM t_the a LEFT JOIN t_of b USING (rid)"))
def q_adjust_negative(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "the ~of")


@query(_q("SELECT rid, (5 * tf)::BIGINT AS score FROM t_the WHERE rid IN (SELECT rid FROM t_and UNION SELECT rid FROM t_to) AND (SELECT count(*) FROM t_the) <= (SELECT count(*) FROM (SELECT rid FROM t_and UNION SELECT rid FROM t_to)) "
  "UNION ALL SELECT rid, (5 * (coalesce(a.tf, 0) + coalesce(b.tf, 0)))::BIGINT FROM t_and a FULL JOIN t_to b USING (rid) WHERE rid IN (SELECT rid FROM t_the) AND (SELECT count(*) FROM t_the) > (SELECT count(*) FROM (SELECT rid FROM t_and UNION SELECT rid FROM t_to))"))  # fmt: skip
def q_group(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "the +(and to)")


@query(_q("SELECT rid, (5 * tf)::BIGINT AS score FROM t_the"))
def q_leading_minus(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "-of the")


@query(_q("SELECT rid, (5 * (a.tf + b.tf + c.tf))::BIGINT AS score FROM t_the a JOIN t_of b USING (rid) JOIN t_and c USING (rid)"))
def q_default_op(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "*D+ the of and")


@query(f"""WITH {TOK}, {TF}, hit AS (SELECT rid, 2 * tf AS score FROM tf WHERE term = 'the' UNION ALL SELECT doc_id, 7 FROM documents WHERE source = 'the')
SELECT rid, sum(score)::BIGINT AS score, count(*)::BIGINT AS n_subrecs FROM hit GROUP BY rid""")
def q_section_weight(s: SparkSession, d: str) -> DataFrame:
    ix = TextIndex.of_columns(table(s, d, "documents"), "doc_id", ["text", "source"])
    return _scores(search(ix, "*W1:2,2:7 the"), "n_subrecs")


@query("SELECT doc_id AS rid, 2::BIGINT AS score, 1::BIGINT AS n_subrecs FROM documents WHERE source = 'src3'")
def q_section_excluded(s: SparkSession, d: str) -> DataFrame:
    ix = TextIndex.of_columns(table(s, d, "documents"), "doc_id", ["text", "source"])
    return _scores(search(ix, "*W2:2 src3"), "n_subrecs")


@query(_phrase_sql(["of", "the"]).replace("count(*)::BIGINT AS score FROM st", "(5 * count(*))::BIGINT AS score FROM st"))
def q_phrase(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, '"of the"')


@query(f"""WITH {TOK}, {TF}, e AS (SELECT rid, 5 * tf AS score FROM tf WHERE term = 'thou'), u AS (SELECT rid, 3 * arg_min(tf, first_pos) AS score FROM tf WHERE starts_with(term, 'thou') GROUP BY rid)
SELECT rid, score::BIGINT AS score FROM e UNION ALL SELECT rid, score::BIGINT FROM u WHERE rid NOT IN (SELECT rid FROM e)""")
def q_escalation(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, "*E-3 thou")


@query("""WITH x AS (SELECT doc_id, regexp_replace(text, '[ \\f\\n\\r\\t\\x0B\\x{3000}]', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, (length(t) - length(replace(t, 'ther', ''))) // 4 AS a, (length(t) - length(replace(t, 'und', ''))) // 3 AS b FROM x)
SELECT doc_id, (5 * a)::BIGINT AS score FROM c WHERE a > 0 AND b = 0""")
def scan_query(s: SparkSession, d: str) -> DataFrame:
    found, score = scan("ther -und", [F.col("text")])
    return table(s, d, "documents").select("doc_id", found.alias("found"), score.alias("score")).where("found").drop("found")


# --- record sets


def _two(s: SparkSession, d: str) -> tuple[Records, Records]:
    ix = index(s, d)
    return select(ix, "the"), select(ix, "of")


@query(_q("SELECT rid, tf AS score FROM t_the UNION ALL SELECT rid, tf FROM t_of WHERE rid NOT IN (SELECT rid FROM t_the)"))
def rec_union(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return _scores(a.union(b))


@query(_q("SELECT rid, CASE WHEN (SELECT count(*) FROM t_the) <= (SELECT count(*) FROM t_of) THEN a.tf ELSE b.tf END AS score FROM t_the a JOIN t_of b USING (rid)"))
def rec_intersect(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return _scores(a.intersect(b))


@query(_q("SELECT rid, tf AS score FROM t_the WHERE rid NOT IN (SELECT rid FROM t_of)"))
def rec_subtract(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return _scores(a.subtract(b))


@query(_q("SELECT rid, tf AS score, 'a' AS side FROM t_the WHERE rid NOT IN (SELECT rid FROM t_of) UNION ALL SELECT rid, tf, 'b' FROM t_of WHERE rid NOT IN (SELECT rid FROM t_the)"))
def rec_difference(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    x, y, _ = a.difference(b)
    return _scores(x).withColumn("side", F.lit("a")).unionByName(_scores(y).withColumn("side", F.lit("b")))


@query(_q("SELECT rid, tf AS score FROM t_the ORDER BY tf DESC, rid LIMIT 10"))
def rec_sort_topk(s: SparkSession, d: str) -> DataFrame:
    return select(index(s, d), "the").sort(limit=10).select("rid", "score")


@query(_q("SELECT rid, tf AS score FROM t_the ORDER BY tf DESC, rid LIMIT 10 OFFSET 5"))
def rec_page(s: SparkSession, d: str) -> DataFrame:
    return select(index(s, d), "the").page(5, 10).select("rid", "score")


_CONV = f"""ct AS (SELECT conv_id AS rid, (turn + 1)::INTEGER AS sid, unnest(list_filter(regexp_split_to_array(text, {SPLIT}), lambda x: x <> '')) AS term FROM conversations),
hit AS (SELECT rid, sid, count(*) AS score FROM ct WHERE term = 'the' GROUP BY rid, sid)"""


def _conversations(s: SparkSession, d: str) -> Records:
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("rid"), (F.col("turn") + 1).cast("int").alias("sid"), F.array(F.struct(F.col("text").alias("str"), F.lit(0).alias("weight"))).alias("values"))
    return select(TextIndex.build(rows), "the", unit="section")


@query(f"WITH {_CONV} SELECT rid, sum(score)::BIGINT AS score, count(*)::BIGINT AS n_subrecs FROM hit GROUP BY rid")
def rec_group_count(s: SparkSession, d: str) -> DataFrame:
    return _scores(_conversations(s, d).group("document"), "n_subrecs")


@query(f"""WITH {_CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, sid) AS rn FROM hit)
SELECT rid, score::BIGINT AS score, sid FROM r WHERE rn <= 2""")
def rec_group_subrecs(s: SparkSession, d: str) -> DataFrame:
    g = _conversations(s, d).group("document", limit=2)
    return g.df.select("rid", F.explode("subrecs").alias("x")).select("rid", "x.score", "x.sid")


@query(f"WITH {_CONV} SELECT (sid % 2)::INTEGER AS key, sum(score)::BIGINT AS score, count(*)::BIGINT AS n_subrecs FROM hit WHERE sid > 1 GROUP BY 1")
def rec_group_userdef(s: SparkSession, d: str) -> DataFrame:
    return _conversations(s, d).group(key=F.col("sid") % 2, where=F.col("sid") > 1).df


@query(_q("SELECT rid, tf AS score, 0 AS source FROM t_the UNION ALL SELECT rid, tf, 1 FROM t_of"))
def rec_merge_k(s: SparkSession, d: str) -> DataFrame:
    return merge(list(_two(s, d))).select("rid", "score", "source")


# --- tables


def catalog(s: SparkSession, d: str) -> Catalog:
    c = Catalog(s)
    refs = {
        "region": ("r_regionkey", {}),
        "nation": ("n_nationkey", {"n_regionkey": "region"}),
        "customer": ("c_custkey", {"c_nationkey": "nation"}),
        "orders": ("o_orderkey", {"o_custkey": "customer"}),
        "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
        "part": ("p_partkey", {}),
        "events": ("event_id", {}),
        "documents": ("doc_id", {}),
        "labels": ("doc_id", {}),
    }
    for name, (key, to) in refs.items():
        df = table(s, d, name)
        c.create_table(name, df, key, slots={k: Slot("reference", to[k]) if k in to else Slot("text") for k in df.columns if k != key})
    return c


@query("SELECT c_custkey AS rid, 0::BIGINT AS score FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def tbl_scan_select(s: SparkSession, d: str) -> DataFrame:
    return _scores(catalog(s, d).tables["customer"].scan_select((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING")))


def _rich(t: Table) -> tuple[Records, Column]:
    return t.scan_select(F.col("c_acctbal") > 5000), F.col("c_mktsegment") == "BUILDING"


@query("SELECT c_custkey AS rid FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def tbl_scan_and(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["customer"]
    r, cond = _rich(t)
    return t.scan_select(cond, r, Q.AND).df.select("rid")


@query("SELECT c_custkey AS rid FROM customer WHERE c_acctbal > 5000 AND NOT (c_mktsegment = 'BUILDING')")
def tbl_scan_but(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["customer"]
    r, cond = _rich(t)
    return t.scan_select(cond, r, Q.BUT).df.select("rid")


@query("SELECT c_custkey AS rid FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def tbl_scan_or(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["customer"]
    r, cond = _rich(t)
    return t.scan_select(cond, r, Q.OR).df.select("rid")


@query("""SELECT o_orderkey, c_name AS o_custkey_c_name, n_name AS o_custkey_c_nationkey_n_name, r_name AS o_custkey_c_nationkey_n_regionkey_r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def tbl_path_deref(s: SparkSession, d: str) -> DataFrame:
    paths = ("o_custkey.c_name", "o_custkey.c_nationkey.n_name", "o_custkey.c_nationkey.n_regionkey.r_name")
    return catalog(s, d).tables["orders"].path(*paths).select("o_orderkey", *[p.replace(".", "_") for p in paths])


@query("SELECT c_custkey AS rid FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def tbl_scan_path(s: SparkSession, d: str) -> DataFrame:
    r = catalog(s, d).tables["customer"].scan_select(F.col("c_nationkey_n_regionkey_r_name") == "ASIA", paths=("c_nationkey.n_regionkey.r_name",))
    return r.df.select("rid")


@query("SELECT o_custkey AS rid, 0::BIGINT AS score, count(*)::BIGINT AS n_subrecs FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
def tbl_group_ref(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["orders"]
    return t.group(t.scan_select(F.col("o_totalprice") > 100000), "o_custkey").df


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def rec_sort_key(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["customer"]
    return t.sort(t.scan_select(F.col("c_mktsegment") == "BUILDING"), "c_acctbal", 10).select("c_custkey", "c_acctbal")


@query("""SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'fr' ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 50""")
def rec_sort_slot_nulls(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
    t = Table("documents", docs, "doc_id", {"lang": Slot("text"), "quality": Slot("int")})
    return t.sort(t.scan_select(F.col("lang") == "fr"), "quality", 50, ascending=True).select("doc_id", "quality")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 's')")
def tbl_key_prefix(s: SparkSession, d: str) -> DataFrame:
    t = Table("part", table(s, d, "part").select("p_name", "p_partkey"), "p_name")
    return t.prefix_search("s").select("p_partkey", "p_name")


@query("SELECT DISTINCT p_name FROM part WHERE starts_with((SELECT min(p_name) FROM part) || ' and more', p_name) ORDER BY length(p_name) DESC LIMIT 1")
def tbl_common_prefix(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select("p_name").distinct()
    text = part.agg(F.min("p_name")).first()[0] + " and more"
    return Table("part", part, "p_name").common_prefix_search(text)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def tbl_time_sort(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["events"]
    return t.sort(t.as_records(), "ts", 10).select("event_id", "ts")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey ORDER BY r_name DESC, n_nationkey LIMIT 10")
def tbl_sort_path(s: SparkSession, d: str) -> DataFrame:
    t = catalog(s, d).tables["nation"]
    got = t.sort(t.as_records(), "n_regionkey.r_name", 10)
    return got.select("n_nationkey", "n_name", F.col("n_regionkey_r_name").alias("r_name"))


@query(f"WITH {TOK}, {TF} SELECT doc_id, lang, (5 * (a.tf + b.tf))::BIGINT AS score FROM documents JOIN tf a ON a.rid = doc_id AND a.term = 'the' JOIN tf b ON b.rid = doc_id AND b.term = 'of'")
def tbl_fulltext(s: SparkSession, d: str) -> DataFrame:
    c = catalog(s, d)
    c.create_table("terms")
    c.build_index("terms", "text", "documents", "text")
    return c.tables["documents"].of(c.search("terms", "text", "the of")).select("doc_id", "lang", "score")


# --- scalar functions


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey // 7)::BIGINT AS div7, (l_orderkey % 7)::BIGINT AS rem7, (l_orderkey + l_partkey - l_suppkey)::BIGINT AS sum3,
CASE WHEN l_linenumber = 1 THEN NULL ELSE (l_orderkey // (l_linenumber - 1))::BIGINT END AS safe, repeat(l_returnflag, 3) AS rep FROM lineitem""")
def fn_math(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.divide(c("l_orderkey"), 7).alias("div7"), S.remainder(c("l_orderkey"), 7).cast("long").alias("rem7"),
        S.subtract(S.add(c("l_orderkey"), c("l_partkey")), c("l_suppkey")).alias("sum3"), S.divide(c("l_orderkey"), c("l_linenumber") - 1).alias("safe"), S.repeat(c("l_returnflag"), 3).alias("rep"),
    )


@query("SELECT l_orderkey, l_linenumber, (l_linenumber < l_quantity AND l_quantity < 30) AS chain, l_returnflag >= 'N' AS ge, l_discount > 0 AS pos, l_tax = 0 AS zero FROM lineitem")
def fn_compare(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.lt(c("l_linenumber"), c("l_quantity"), 30).alias("chain"), S.ge(c("l_returnflag"), "N").alias("ge"), S.is_positive(c("l_discount")).alias("pos"), S.is_zero(c("l_tax")).alias("zero"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS mid, right(p_name, 1) AS last FROM part")
def fn_substrb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", S.substrb(F.col("p_name"), 1, 3).alias("mid"), S.substrb(F.col("p_name"), -2, -1).alias("last"))


@query("SELECT doc_id, coalesce(try_cast(substr(source, 4) AS DOUBLE), 0) AS n, coalesce(try_cast(source AS DOUBLE), 0) AS none FROM documents")
def fn_tonumber(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", S.to_number(F.expr("substring(source, 4)")).alias("n"), S.to_number(F.col("source")).alias("none"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS str, ts AS back FROM events")
def fn_time(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", S.timestr(F.col("ts")).alias("str"), S.to_time(F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")).alias("back"))


@query("SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS got FROM events")
def fn_json_read(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", S.json_read(F.col("props"), "k string")["k"].alias("k"), S.json_get(F.col("props"), "$.k").alias("got"))


@query("SELECT doc_id, lower(regexp_replace(text, '[\\x00-\\x1f]', '', 'g')) AS norm FROM documents")
def doc_normalize_ascii(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.normalize_ascii(F.col("text")).alias("norm"))


@query()
def doc_normalize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("""WITH r AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+|[\\p{P}\\p{S}]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM r)
SELECT doc_id, term, coalesce(sum(length(term)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS pos FROM u""")
def ngram_runs(s: SparkSession, d: str) -> DataFrame:
    return run_rows(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "term", "pos")


@query()
def ngram_tokens(s: SparkSession, d: str) -> DataFrame:
    return token_rows(table(s, d, "documents"), "doc_id", "text", Tokenizer("ngram", normalize=True))


# --- dictionary, snippets, input and output, updates


@query()
def dict_scan(s: SparkSession, d: str) -> DataFrame:
    keys = s.createDataFrame([("thing",), ("heren",), ("tion of",), ("verkeit",)], "key string")
    return lexicon.dictionary_scan(table(s, d, "documents").select("doc_id", "text"), F.col("text"), keys).select("doc_id", "key", "offset", "length")


@query()
def snippet_kwic(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", snippet(F.col("text"), [("the", "[", "]"), ("der", "<", ">")], 80, 3).alias("snippets"))


@query()
def snippet_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", query_snippet(F.col("text"), "the +of -and", [("[", "]"), ("<", ">")], 80, 2).alias("snippets"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_tsv(s: SparkSession, d: str) -> DataFrame:
    at = fresh_path(s, "tsv")
    tsv.write_tsv(table(s, d, "nation"), at)
    return tsv.load_tsv(s, at, ["n_name", "n_regionkey"], "n_nationkey", {"n_regionkey": "int"}).withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 1")
def stream_tsv(s: SparkSession, d: str) -> DataFrame:
    at, out = fresh_path(s, "tsv"), fresh_path(s, "lines")
    tsv.write_tsv(table(s, d, "nation"), at)
    lines = s.readStream.text(at).select(F.split("value", "\t").alias("f"))
    rows = lines.select(F.col("f")[0].cast("int").alias("n_nationkey"), F.col("f")[1].alias("n_name"), F.col("f")[2].cast("int").alias("n_regionkey")).where("n_regionkey > 1")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(s, "progress")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS value FROM nation")
def out_tsv(s: SparkSession, d: str) -> DataFrame:
    return tsv.tsv_lines(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def out_json(s: SparkSession, d: str) -> DataFrame:
    return tsv.json_lines(table(s, d, "region"), ["r_regionkey", "r_name"], limit=0)


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN replace(text, 'e', 'E') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4),
tok AS (SELECT doc_id AS rid, unnest(list_filter(regexp_split_to_array(text, {SPLIT}), lambda x: x <> '')) AS term FROM x)
SELECT term, count(DISTINCT rid)::BIGINT AS df, count(*)::BIGINT AS cf FROM tok GROUP BY term""")
def upd_incremental(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    ix = index(s, d).save(fresh_path(s))
    ix = ix.upsert(sections(docs.where("doc_id % 10 = 3").withColumn("text", F.replace(F.col("text"), F.lit("e"), F.lit("E"))), "doc_id", ["text"]))
    ix = ix.delete(docs.where("doc_id % 10 = 4").select(F.col("doc_id").alias("rid"))).compact()
    return ix.lexicon().drop("n_chars")


@query(f"WITH {TOK} SELECT term, count(DISTINCT rid)::BIGINT AS df, count(*)::BIGINT AS cf FROM tok GROUP BY term")
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    from inkwell.streaming.ingest import follow

    docs = table(s, d, "documents")
    at = fresh_path(s)
    TextIndex.of_columns(docs.limit(0), "doc_id", ["text"]).save(at)
    stream = s.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet")
    follow(stream, at, "doc_id", ["text"], fresh_path(s, "progress")).awaitTermination()
    return TextIndex.open(s, at).lexicon().drop("n_chars")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Top ten of a query over an index, with snippets."""
    docs = table(s, d, "documents")
    top = search(index(s, d), "*D+ the of").sort(limit=10)
    cut = snippet(F.col("text"), [("the", "[", "]"), ("of", "[", "]")], 80, 2)
    return F.broadcast(top).join(docs, F.col("rid") == F.col("doc_id")).select("doc_id", "score", cut.alias("snippets")).orderBy(F.desc("score"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
