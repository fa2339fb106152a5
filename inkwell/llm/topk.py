"""Exact top-k search of documents by exhaustive term-at-a-time accumulation.

Queries are sparse rows of term counts, in blocks of a bounded size. Documents
are a written inverted index in shards. In each shard a query scatters its
weighted postings into a dense array of scores, one for each document, and a
partial selection keeps the k best. Shards merge within a task, tasks merge in
a window. Nothing is skipped, so the result is exact (see ``postings`` for the
impacts, which are whole numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import postings as P
from inkwell.llm import textvec as tv

K = 10
ONE_IN = 100  # the stated query set: documents whose id it divides


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest positive scores, ties by id."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): for every query row its k best documents.

    ``queries`` has query_id and text. Only positive scores count; equal ones go
    by doc_id. Documents with a null id are left out, also of the statistics;
    null and empty texts have no words but count as documents. A null query_id
    is reported as null (such rows are queries of their own). Rows that repeat
    an id are documents (or queries) of their own. Other columns aren't read;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    index = P.build(docs)
    out, base = None, 0
    for block in P.blocks(queries.select(F.col("query_id").cast("long"), F.col("text").cast("string"))):
        got = _one(index.df, block, base, k)
        names = spark.createDataFrame(pa.table([pa.array(range(base, base + len(block.ids)), pa.int64()), pa.array(block.ids, pa.int64())], names=["q", "query_id"]), "q long, query_id long")
        base += len(block.ids)
        got = got.join(F.broadcast(names), "q").select("query_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out


def _one(index: DataFrame, block: P.Block, base: int, k: int) -> DataFrame:
    sc = index.sparkSession.sparkContext
    stats = P.Statistics(index, block)
    shared = sc.broadcast((block, stats.idf, stats.mean))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idf, mean = shared.value
        top = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block.ids]
        for _, shard in P.shards(it, block, idf, mean):
            for i, score in shard.scores(block, True):
                a, s = top[i]
                if len(a) == k:  # only what beats or ties the worst kept
                    score[score < s[-1]] = 0
                good = best(score, shard.ids, k)
                if len(good):
                    a, s = np.concatenate((a, shard.ids[good])), np.concatenate((s, score[good].astype(np.int64)))
                    keep = best(s, a, k)
                    top[i] = a[keep], s[keep]
        n = [len(a) for a, _ in top]
        e = [np.empty(0, np.int64)]
        yield pa.record_batch(
            [pa.array(np.repeat(np.arange(len(n)), n) + base), pa.array(np.concatenate(e + [a for a, _ in top])), pa.array(np.concatenate(e + [s for _, s in top]))],
            ["q", "doc_id", "score"],
        )

    found = index.select(*P.COLUMNS).mapInArrow(run, "q long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def sql(word_re: str = tv.WORD_RE, k: int = K, queries: str = f"SELECT doc_id AS query_id, text FROM documents WHERE doc_id % {ONE_IN} = 0") -> str:
    """DuckDB SQL of ``search`` over documents, with every document whose id ONE_IN divides as a query."""
    return f"""
WITH d0 AS (SELECT row_number() OVER () AS did, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word_re}') AS w FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT did, unnest(w) AS t FROM d0),
tf AS (SELECT did, t, count(*) AS tf FROM w GROUP BY did, t),
s AS (SELECT count(*)::DOUBLE AS nd, sum(len(w))::DOUBLE AS nw FROM d0),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
q0 AS (SELECT row_number() OVER () AS qid, query_id, regexp_extract_all(lower(coalesce(text, '')), '{word_re}') AS w FROM ({queries})),
q AS (SELECT qid, t, count(*) AS qtf FROM (SELECT qid, unnest(w) AS t FROM q0) GROUP BY qid, t),
sc AS (SELECT qid, tf.did, sum(qtf * floor(1000 * (ln(1 + (nd - df + 0.5) / (df + 0.5)) * (tf * ({P.K1} + 1) / (tf + {P.K1} * (1 - {P.B} + {P.B} * len(d0.w) / (nw / nd)))))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d0 ON d0.did = tf.did, s GROUP BY qid, tf.did),
r AS (SELECT sc.*, d0.doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d0.doc_id) AS rank FROM sc JOIN d0 USING (did) WHERE score > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN q0 USING (qid) WHERE rank <= {k}"""
