"""The positional inverted index: ordinary tables of postings and documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.compat import DEFAULT, Compat
from inkwell.operators.tokenize import Tokenizer, slices
from inkwell.sources import store
from inkwell.sources.store import prepare

VALUES = "array<struct<str:string,weight:int>>"
VALUE_GAP = 1 << 32  # positions between the beginnings of a section's values; no value has as many tokens
DEAD_ROWS = 1_000_000  # keys of replaced or deleted records up to which they are broadcast
_SPREAD = 16  # files of a saved index that a term is in at most
_WIDE_SPACE = "\u3000".encode()


def sections(df: DataFrame, key: str, columns: list[str | Column], weights: list[int] | None = None) -> DataFrame:
    """(rid, sid, values): each column is a section, numbered from 1; missing text gives no section."""
    parts = []
    for i, c in enumerate(columns):
        col = F.col(c) if isinstance(c, str) else c
        w = weights[i] if weights else 0
        parts.append(F.struct(F.lit(i + 1).alias("sid"), F.array(F.struct(col.cast("string").alias("str"), F.lit(w).alias("weight"))).alias("values")))
    rows = df.select(F.col(key).alias("rid"), F.explode(F.array(*parts)).alias("s"))
    return rows.select("rid", "s.sid", "s.values").where(F.col("values")[0]["str"].isNotNull())


def postings(rows: DataFrame, tokenizer: Tokenizer, compat: Compat = DEFAULT) -> DataFrame:
    """(term, rid, sid, tf, wsum, positions) of (rid, sid, values).

    wsum adds up the weight of the value that each occurrence is in. Later
    values of a section start VALUE_GAP positions on, so phrases don't cross.
    """
    prepare(rows.sparkSession)
    again = rows.groupBy("rid", "sid").count().where("count > 1").select(F.col("rid").alias("r_"), F.col("sid").alias("s_"))
    if again.isEmpty():
        out = _folded(rows, tokenizer, compat)
    else:  # rows that share a key are merged, the others need no shuffle
        same = F.col("rid").eqNullSafe(F.col("r_")) & F.col("sid").eqNullSafe(F.col("s_"))
        several = _folded(rows.join(again, same, "left_semi"), tokenizer, compat).groupBy("term", "rid", "sid")
        several = several.agg(F.sum("tf").cast("int").alias("tf"), F.sum("wsum").cast("int").alias("wsum"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        out = _folded(rows.join(again, same, "left_anti"), tokenizer, compat).unionByName(several)
    if compat.tf_cap:
        n = F.lit(compat.tf_cap)
        out = out.withColumn("tf", F.least("tf", n)).withColumn("positions", F.slice("positions", 1, n))
    return out


class _Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, key: bytes | str) -> int:
        self[key] = n = len(self)
        return n


def _folded(rows: DataFrame, tokenizer: Tokenizer, compat: Compat) -> DataFrame:
    """Postings of each row by itself. Tokens are grouped where they are cut, so no token travels alone."""
    plain = tokenizer.kind == "delimited" and not tokenizer.normalize

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(2)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)  # of each value
            vno = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            values = lists.flatten()
            text, weight = pc.struct_field(values, "str"), pc.fill_null(pc.struct_field(values, "weight"), 0).to_numpy(zero_copy_only=False)
            at = 0
            # a row's values stay together
            for lo, hi in slices(text):
                hi = int(np.searchsorted(row, row[hi - 1], side="right"))
                if hi > at:
                    yield from cut(b, text[at:hi], row[at:hi], vno[at:hi], weight[at:hi])
                    at = hi

    def cut(b: pa.RecordBatch, text: pa.Array, row: np.ndarray, vno: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        if plain:  # bytes.split cuts at the ASCII characters of T.SPACE
            words = [x.replace(_WIDE_SPACE, b" ").split() if x else [] for x in text.view(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        else:
            got = [tokenizer.tokens(x) if x else [] for x in text.to_pylist()]
            n = np.fromiter(map(len, got), np.int64, len(got))
            pos = np.fromiter((p for g in got for _, p in g), np.int64, n.sum())
            words = [[t for t, _ in g] for g in got]
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, n.sum())
        if not len(code):
            return
        if not compat.overlap_values:
            pos = pos + np.repeat(vno, n) * VALUE_GAP
        key = np.repeat(row, n) * len(number) + code
        order = np.lexsort((pos, key)) if compat.overlap_values else np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        row, code = np.divmod(key[first], len(number))
        term = pa.array(list(number), pa.binary()).view(pa.string()) if plain else pa.array(list(number), pa.string())
        wsum = np.add.reduceat(np.repeat(weight, n)[order], first)
        ends = np.append(first, len(key))
        yield pa.record_batch(
            [term.take(pa.array(code)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(np.diff(ends).astype(np.int32)), pa.array(wsum.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos))],
            ["term", "rid", "sid", "tf", "wsum", "positions"],
        )

    rows = rows.select("rid", "sid", F.col("values").cast(VALUES).alias("values"))
    kinds = rows.select(F.lit("").alias("term"), "rid", "sid", F.lit(0).alias("tf"), F.lit(0).alias("wsum"), F.array().cast("array<long>").alias("positions")).schema
    return rows.mapInArrow(run, kinds)


def _without(posts: DataFrame, dead: DataFrame, on: list[str]) -> DataFrame:
    """Postings without those of some keys. Up to DEAD_ROWS keys are broadcast, so that the postings stay where they are."""
    return posts.join(F.broadcast(dead) if dead.count() <= DEAD_ROWS else dead, on, "left_anti")


def _alive(posts: DataFrame, dead: DataFrame | None) -> DataFrame:
    if dead is None:
        return posts
    for on, keys in ((["rid", "sid"], dead.where("sid is not null")), (["rid"], dead.where("sid is null").select("rid"))):
        posts = _without(posts, keys.distinct(), on)
    return posts


@dataclass(frozen=True)
class TextIndex:
    """Postings over sections of documents, held in memory as a plan or under a path.

    Under a path: ``base-N`` and ``delta-N`` folders. A delta has the postings
    of replaced sections and the list of (rid, sid) it replaces; it counts once
    its postings are complete, so readers see whole updates only. Files are
    sorted by term, so a term's pages are found by their statistics. Each save and
    delta has a term in _SPREAD files at most, by the hash of term and document;
    ``compact`` leaves postings where they are.
    """

    postings: DataFrame
    docs: DataFrame
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    compat: Compat = DEFAULT
    linked_suffixes: bool = False  # suffix search over non-ASCII terms
    path: str | None = None
    n_sections: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    # --- building

    @staticmethod
    def build(rows: DataFrame, tokenizer: Tokenizer | None = None, compat: Compat = DEFAULT, linked_suffixes: bool = False) -> TextIndex:
        """Index of (rid, sid, values)."""
        tokenizer = replace(tokenizer or Tokenizer(), compat=compat)
        docs = rows.select("rid").distinct().withColumn("deleted", F.lit(False))
        return TextIndex(postings(rows, tokenizer, compat), docs, tokenizer, compat, linked_suffixes)

    @staticmethod
    def of_columns(df: DataFrame, key: str, columns: list[str | Column], tokenizer: Tokenizer | None = None, weights: list[int] | None = None, compat: Compat = DEFAULT) -> TextIndex:
        out = TextIndex.build(sections(df, key, columns, weights), tokenizer, compat)
        return replace(out, n_sections=len(columns))

    def cache(self) -> TextIndex:
        return replace(self, postings=self.postings.cache(), docs=self.docs.cache())

    # --- storage

    def save(self, path: str) -> TextIndex:
        """Writes base 0 and opens it. The tokenizer's settings go along (an analyser must be given again)."""
        t = self.tokenizer
        meta = {"kind": t.kind, "normalize": t.normalize, "split_alpha": t.split_alpha, "split_digit": t.split_digit, "split_symbol": t.split_symbol, "linked_suffixes": self.linked_suffixes, "n_sections": self.n_sections}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self._write(f"{path}/base-{0:06d}", self.postings, self.docs)
        return TextIndex.open(self.spark, path, self.compat)

    @staticmethod
    def _write(at: str, posts: DataFrame, docs: DataFrame, dead: DataFrame | None = None, placed: bool = False) -> None:
        """``placed``: postings read from files of an index, which are sorted anew where they are."""
        docs.write.parquet(f"{at}/docs")
        if dead is not None:
            dead.write.parquet(f"{at}/dead")
        if not placed:
            posts = posts.repartition("term", F.pmod(F.hash("rid"), F.lit(_SPREAD)))
        posts.sortWithinPartitions("term", "rid", "sid").write.parquet(f"{at}/postings")

    @staticmethod
    def open(spark: SparkSession, path: str, compat: Compat = DEFAULT, analyse: object = None) -> TextIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        linked, n_sections = meta.pop("linked_suffixes"), meta.pop("n_sections")
        names = [n for n in store.folders(spark, path) if n[:5] in ("base-", "delta") and store.exists(spark, f"{path}/{n}/postings/_SUCCESS")]
        base = max(n for n in names if n.startswith("base-"))
        first = int(base.split("-")[1])
        deltas = [n for n in names if n.startswith("delta-") and int(n.split("-")[1]) > first]
        read = lambda n, t: spark.read.parquet(f"{path}/{n}/{t}").withColumn("version", F.lit(int(n.split("-")[1])))
        posts, docs = read(base, "postings"), read(base, "docs")
        if deltas:
            # each version loses what later ones replace; a null sid replaces all sections of a document
            parts, dead = [], None
            for n in reversed(deltas):
                parts.append(_alive(read(n, "postings"), dead))
                mine = spark.read.parquet(f"{path}/{n}/dead")
                dead = mine if dead is None else dead.unionByName(mine)
                docs = docs.unionByName(read(n, "docs"))
            posts = _alive(posts, dead)
            for part in parts:
                posts = posts.unionByName(part)
            docs = docs.groupBy("rid").agg(F.max_by("deleted", "version").alias("deleted"), F.max_by("gone", "version").alias("gone")) if "gone" in docs.columns else docs.groupBy("rid").agg(F.max_by("deleted", "version").alias("deleted"))
        posts = posts.select("term", "rid", "sid", "tf", "wsum", "positions")
        return TextIndex(posts, docs.select("rid", "deleted"), Tokenizer(**meta, analyse=analyse, compat=compat), compat, linked, path, n_sections)

    def _next(self) -> int:
        return 1 + max(int(n.split("-")[1]) for n in store.folders(self.spark, self.path) if n[:5] in ("base-", "delta"))

    def upsert(self, rows: DataFrame) -> TextIndex:
        """Replaces the sections in (rid, sid, values); sections without text are taken out."""
        new = postings(rows.where("size(values) > 0"), self.tokenizer, self.compat)
        docs = rows.select("rid").distinct().withColumn("deleted", F.lit(False))
        dead = rows.select("rid", "sid").distinct()
        if self.path is None:
            kept = self.postings.join(dead, ["rid", "sid"], "left_anti")
            return replace(self, postings=kept.unionByName(new), docs=self.docs.join(docs, "rid", "left_anti").unionByName(docs))
        self._write(f"{self.path}/delta-{self._next():06d}", new, docs, dead)
        return TextIndex.open(self.spark, self.path, self.compat, self.tokenizer.analyse)

    def delete(self, keys: DataFrame) -> TextIndex:
        """Takes documents (column rid) out of the index for good."""
        keys = keys.select("rid").distinct()
        if self.path is None:
            return replace(self, postings=self.postings.join(keys, "rid", "left_anti"), docs=self.docs.join(keys, "rid", "left_anti"))
        dead = keys.withColumn("sid", F.lit(None).cast("int"))
        self._write(f"{self.path}/delta-{self._next():06d}", self.postings.limit(0), keys.withColumn("deleted", F.lit(True)), dead)
        return TextIndex.open(self.spark, self.path, self.compat, self.tokenizer.analyse)

    def mark_deleted(self, keys: DataFrame) -> TextIndex:
        """Logical deletion: documents stay in the index but ``live`` leaves them out, and ``compact`` drops them. Under a path the mark is written, and a later update of the document lifts it."""
        if self.path is not None:
            marks = keys.select("rid").distinct().withColumn("deleted", F.lit(True))
            none = marks.limit(0).select("rid", F.lit(None).cast("int").alias("sid"))
            self._write(f"{self.path}/delta-{self._next():06d}", self.postings.limit(0), marks, none)
            return TextIndex.open(self.spark, self.path, self.compat, self.tokenizer.analyse)
        mark = keys.select("rid").distinct().withColumn("mark_", F.lit(True))
        return replace(self, docs=self.docs.join(mark, "rid", "left").select("rid", (F.col("deleted") | F.coalesce("mark_", F.lit(False))).alias("deleted")))

    def live(self) -> TextIndex:
        gone = self.docs.where("deleted").select("rid")
        return replace(self, postings=self.postings.join(gone, "rid", "left_anti") if self.path is None else _without(self.postings, gone, ["rid"]))

    def compact(self) -> TextIndex:
        """Merges all deltas into a new base, without what is deleted; readers of the old one aren't disturbed."""
        live = self.live()
        self._write(f"{self.path}/base-{self._next():06d}", live.postings, live.docs.where("not deleted"), placed=True)
        return TextIndex.open(self.spark, self.path, self.compat, self.tokenizer.analyse)

    def rename(self, path: str) -> TextIndex:
        store.rename(self.spark, self.path, path)
        return TextIndex.open(self.spark, path, self.compat, self.tokenizer.analyse)

    def remove(self) -> None:
        store.remove(self.spark, self.path)

    # --- what is in it

    def lexicon(self) -> DataFrame:
        """(term, df, cf, n_chars): documents and occurrences of each term."""
        n_docs = F.count("*") if self.n_sections == 1 else F.count_distinct("rid")  # one section: a posting per document
        return self.postings.groupBy("term").agg(n_docs.alias("df"), F.sum("tf").cast("long").alias("cf")).withColumn("n_chars", F.length("term"))

    def scan(self, term: str) -> DataFrame:
        """One term's postings in order."""
        return self.postings.where(F.col("term") == term).orderBy("rid", "sid")

    def info(self) -> dict[str, int | str | None]:
        r = self.postings.agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
        return {"postings": r.n, "terms": r.terms, "tokens": r.tokens, "documents": self.docs.count(), "path": self.path}

    def with_keys(self, docs: DataFrame) -> TextIndex:
        """The same postings over a document table shared with other indexes."""
        return replace(self, docs=docs)


def fresh_path(spark: SparkSession, name: str = "index") -> str:
    return f"{store.shared_dir(spark).rstrip('/')}/inkwell/{name}-{uuid.uuid4().hex}"
