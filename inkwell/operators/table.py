"""Tables with keys, references and index columns, and their catalog."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import lexicon
from inkwell.operators.index import TextIndex, sections
from inkwell.operators.records import Records
from inkwell.plans import qparse as Q
from inkwell.plans.qcompile import execute
from inkwell.sources.tsv import load_tsv

#: Column types by name; ``reference`` columns hold the key of a row of another table.
RAW = {"int": "int", "uint": "long", "int64": "long", "float": "double", "shorttext": "string", "text": "string", "longtext": "string", "time": "timestamp"}
LIMITS = {"shorttext": 8192, "text": 65536}
UINT_MAX = 0xFFFFFFFF


def conform(c: Column, kind: str) -> Column:
    """A value of a raw type: integers narrow, unsigned ones are checked, over-long text is an error."""
    out = c.cast(RAW.get(kind, kind))
    if kind == "uint":
        return F.when(out.between(0, UINT_MAX), out).when(out.isNotNull(), F.raise_error(F.lit("not an unsigned number")).cast("long"))
    if kind in LIMITS:
        too_long = F.octet_length(out) > LIMITS[kind]
        return F.when(too_long, F.raise_error(F.lit(f"text longer than {LIMITS[kind]} bytes")).cast("string")).otherwise(out)
    return out


@dataclass(frozen=True)
class Slot:
    kind: str  # a raw type, "reference" or "index"
    target: str = ""  # the referenced table, or table.slot that an index covers


@dataclass(frozen=True)
class Table:
    """Rows (``key``, slots ...). References hold the other table's key, null if none.

    ``surrogate`` tables number their rows themselves.
    """

    name: str
    df: DataFrame
    key: str = "_key"
    slots: dict[str, Slot] = field(default_factory=dict)
    catalog: Catalog | None = None
    surrogate: bool = False

    # --- rows

    def scan(self) -> DataFrame:
        return self.df.orderBy(self.key)

    def get(self, key: object) -> Row | None:
        return self.df.where(F.col(self.key) == key).first()

    def count(self) -> int:
        return self.df.count()

    def _with(self, df: DataFrame) -> Table:
        out = replace(self, df=df)
        if self.catalog:
            self.catalog.tables[self.name] = out
        return out

    def upsert(self, rows: DataFrame) -> Table:
        """New rows, or new values of rows with the same key. Of rows that repeat a key the one that sorts last counts. Index columns over changed slots are brought up to date."""
        cols = [self.key, *[s for s, k in self.slots.items() if k.kind != "index"]]
        have = [c for c in cols if c in rows.columns]
        new = rows.select(*[conform(F.col(c), self.slots[c].kind).alias(c) if c in self.slots and self.slots[c].kind in RAW else F.col(c) for c in have])
        by = F.struct(*[c for c in have if c != self.key]) if len(have) > 1 else F.lit(0)
        new = new.groupBy(self.key).agg(F.max(by).alias("row_")).select(self.key, *([F.col("row_")[c].alias(c) for c in have if c != self.key] if len(have) > 1 else [])).select(have)
        missing = [c for c in cols if c not in have]
        if missing:  # other slots keep their values
            new = new.join(self.df.select(self.key, *missing), self.key, "left").select(cols)
        kept = self.df.join(new.select(self.key), self.key, "left_anti")
        out = self._with(kept.select(cols).unionByName(new.select(cols)))
        out._reindex([c for c in have if c != self.key], new)
        return out

    def _reindex(self, changed: list[str], rows: DataFrame) -> None:
        if not self.catalog:
            return
        for t, s in list(self.catalog.indexes):
            owner, slot = self.catalog.indexes[t, s].covers
            if owner == self.name and slot in changed:
                held = self.catalog.indexes[t, s]
                gone = rows.select(F.col(self.key).alias("rid"))
                index = held.index.delete(gone)
                new = TextIndex.build(sections(rows, self.key, [slot]), index.tokenizer, index.compat)
                if index.path is None:
                    index = replace(index, postings=index.postings.unionByName(new.postings), docs=index.docs.unionByName(new.docs))
                else:
                    index = index.upsert(sections(rows, self.key, [slot]))
                self.catalog.indexes[t, s] = replace(held, index=index)

    def append(self, rows: DataFrame) -> Table:
        """Rows of a surrogate table, numbered on."""
        top = self.df.agg(F.coalesce(F.max(self.key), F.lit(0))).first()[0]
        part = rows.withColumn(self.key, F.monotonically_increasing_id() + F.lit(top + 1))
        return self._with(self.df.unionByName(part, allowMissingColumns=True))

    def delete(self, keys: list[object]) -> Table:
        """Rows go, also from indexes over them; references to them stay as they are."""
        gone = self.df.where(F.col(self.key).isin(keys))
        if self.catalog:
            for at, held in list(self.catalog.indexes.items()):
                if held.covers[0] == self.name:
                    self.catalog.indexes[at] = replace(held, index=held.index.delete(gone.select(F.col(self.key).alias("rid"))))
        return self._with(self.df.where(~F.coalesce(F.col(self.key).isin(keys), F.lit(False))))

    def load(self, path: str, slots: list[str]) -> tuple[Table, int]:
        """Rows from tab-separated lines: (table, number of lines that counted)."""
        rows = load_tsv(self.df.sparkSession, path, slots, self.key, {s: RAW.get(self.slots[s].kind, "string") for s in slots})
        return self.upsert(rows), rows.count()

    # --- columns

    def define(self, slot: str, kind: str, target: str = "") -> Table:
        """Adds a column: of a raw type, or a reference to a table."""
        if slot in self.slots:
            raise ValueError(f"{self.name}.{slot} is there already")
        out = replace(self, slots={**self.slots, slot: Slot(kind, target)})
        return out._with(self.df.withColumn(slot, F.lit(None).cast(RAW.get(kind, dict(self.df.dtypes)[self.key]))) if kind != "index" and slot not in self.df.columns else self.df)

    def undefine(self, slot: str) -> Table:
        left = {s: k for s, k in self.slots.items() if s != slot}
        return replace(self, slots=left)._with(self.df.drop(slot))

    def slot_names(self, prefix: str = "") -> list[str]:
        return [f"{self.name}.{s}" for s in self.slots if s.startswith(prefix)]

    def schema(self) -> str:
        """Statements that would make the table again."""
        lines = [f"create {self.name} key {dict(self.df.dtypes).get(self.key)}" + " surrogate" * self.surrogate]
        lines += [f"define {self.name}.{s} {k.kind} {k.target}".rstrip() for s, k in self.slots.items()]
        return "\n".join(lines)

    def update(self, slot: str, value: Column, where: Column | None = None) -> Table:
        """Writes a column, in the rows that ``where`` picks."""
        kind = self.slots[slot].kind
        new = conform(value, kind) if kind in RAW else value
        picked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        out = self._with(self.df.withColumn(slot, F.when(picked, new).otherwise(F.col(slot))))
        out._reindex([slot], out.df.where(picked))
        return out

    # --- expressions

    def path(self, *paths: str) -> DataFrame:
        """The rows with a column per path expression ``slot1.slot2...`` (named with _ for .).

        Each reference on the way is one left join, shared by all paths that go
        along it. A missing reference gives null.
        """
        df, done = self.df, {}
        out = []
        for p in paths:
            table, prefix = self, ""
            steps = p.split(".")
            for step in steps[:-1]:
                slot = table.slots[step]
                if slot.kind != "reference":
                    raise ValueError(f"{table.name}.{step} isn't a reference")
                here, target = prefix + step, self.catalog.tables[slot.target]
                if here not in done:
                    other = target.df.select(*[F.col(c).alias(f"{here}.{c}") for c in target.df.columns])
                    df = df.join(other, F.col(f"`{prefix}{step}`") == F.col(f"`{here}.{target.key}`"), "left")
                    done[here] = True
                prefix, table = here + ".", target
            last = table.key if steps[-1] == ":key" else steps[-1]
            out.append(F.col(f"`{prefix}{last}`").alias(p.replace(".", "_").replace(":", "")))
        return df.select(*[F.col(f"`{c}`") for c in self.df.columns], *out)

    def as_records(self) -> Records:
        kind = F.lit(0).cast("long")
        return Records(self.df.select(F.col(self.key).alias("rid"), kind.alias("score"), kind.alias("n_subrecs")))

    def scan_select(self, where: Column, records: Records | None = None, op: str = Q.AND, paths: tuple[str, ...] = ()) -> Records:
        """Rows for which ``where`` is true (missing counts as false), with score 0.

        With ``records``: or adds to them; and keeps those of them that match;
        but removes those that match; adjust leaves them.
        """
        df = self.path(*paths) if paths else self.df
        hit = Table(self.name, df.where(F.coalesce(where, F.lit(False))), self.key).as_records()
        if records is None:
            return hit
        return {Q.OR: records.union, Q.AND: lambda h: replace(records, df=records.df.join(h.df.select("rid"), "rid", "left_semi")), Q.BUT: records.subtract}.get(op, lambda _: records)(hit)

    def of(self, records: Records) -> DataFrame:
        """The rows of a record set, with score and n_subrecs."""
        return records.df.join(self.df, F.col("rid") == F.col(self.key)).drop("rid")

    def sort(self, records: Records, key: str = "score", limit: int = 10, ascending: bool = False) -> DataFrame:
        """By ``score``, ``n_subrecs``, the key (``:key``) or a path; missing values are lowest, ties by key. A limit of 0 or less keeps all."""
        plain = {"score": "score", ":score": "score", "n_subrecs": "n_subrecs", ":nsubrecs": "n_subrecs", ":key": self.key}
        if key in plain:
            df, c = self.of(records), plain[key]
        else:
            c = key.replace(".", "_").replace(":", "")
            df = self.of(records) if c in self.df.columns else records.df.join(self.path(key), F.col("rid") == F.col(self.key)).drop("rid")
        out = df.orderBy(F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last(), self.key)
        return out.limit(limit) if limit > 0 else out

    def group(self, records: Records, slot: str, limit: int = 0, ascending: bool = False) -> Records:
        """Records by what a reference slot points to; those without a reference are one group (null)."""
        if self.slots[slot].kind != "reference":
            raise ValueError(f"{slot} isn't a reference")
        rows = records.df.join(self.df.select(F.col(self.key).alias("rid"), F.col(slot).alias("ref_")), "rid")
        got = Records(rows, records.unit, records.compat).group(key=F.col("ref_"), limit=limit, ascending=ascending)
        return Records(got.df.withColumnRenamed("key", "rid"), ("rid",), records.compat)

    def prefix_search(self, prefix: str) -> DataFrame:
        return lexicon.prefix_search(self.df, prefix, self.key)

    def suffix_search(self, suffix: str) -> DataFrame:
        return lexicon.suffix_search(self.df, suffix, self.key, linked=False)

    def common_prefix_search(self, text: str) -> DataFrame:
        return lexicon.common_prefix_search(self.df, text, self.key)


@dataclass(frozen=True)
class IndexSlot:
    index: TextIndex
    covers: tuple[str, str]


class Catalog:
    """Named tables and the index columns over their text."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.indexes: dict[tuple[str, str], IndexSlot] = {}
        self.types: dict[str, int] = {}

    def create_table(self, name: str, df: DataFrame | None = None, key: str = "_key", key_type: str = "string", surrogate: bool = False, slots: dict[str, Slot] | None = None) -> Table:
        if "." in name or name in self.tables:
            raise ValueError(f"no table can be made with the name {name!r}")
        if df is None:
            df = self.spark.createDataFrame([], f"`{key}` {'long' if surrogate else key_type}")
        self.tables[name] = Table(name, df, key, slots or {}, self, surrogate)
        return self.tables[name]

    def typedef(self, name: str, size: int) -> None:
        """A raw type of so many bytes; values are binary and compare byte by byte."""
        self.types[name] = size
        RAW.setdefault(name, "binary")

    def drop(self, name: str) -> None:
        self.tables.pop(name)
        for at in [a for a, held in self.indexes.items() if a[0] == name or held.covers[0] == name]:
            del self.indexes[at]

    def names(self, prefix: str = "") -> list[str]:
        return sorted(n for n in self.tables if n.startswith(prefix))

    def scan(self) -> DataFrame:
        """(name, kind) of all tables and slots."""
        rows = [(t, "table") for t in self.tables] + [(f"{t}.{s}", k.kind) for t, x in self.tables.items() for s, k in x.slots.items()]
        return self.spark.createDataFrame(sorted(rows), "name string, kind string")

    def build_index(self, lexicon_table: str, slot: str, table: str, column: str, tokenizer=None) -> TextIndex:
        """Index column ``lexicon_table.slot`` over the non-empty texts of ``table.column``."""
        t = self.tables[table]
        rows = sections(t.df.where(F.col(column) != ""), t.key, [column])
        index = replace(TextIndex.build(rows, tokenizer), n_sections=1)
        self.indexes[lexicon_table, slot] = IndexSlot(index, (table, column))
        return index

    def search(self, lexicon_table: str, slot: str, text: str, records: Records | None = None, op: str = Q.AND, default_op: str = Q.AND) -> Records:
        """A query over an index column; words are all wanted unless told otherwise."""
        return execute(Q.parse(text, default_op), self.indexes[lexicon_table, slot].index, records, op if records else Q.OR)

    def postings_of(self, lexicon_table: str, slot: str, key: str) -> DataFrame:
        """What an index column holds for a term: the rows it is in."""
        return self.indexes[lexicon_table, slot].index.scan(key)
