from __future__ import annotations

from pathlib import Path

import corpus_pipeline
from inkwell.llm import decontam, packing, quality, simhash, toxicity
from inkwell.llm.common import load
from inkwell.llm.storage import Written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = load(spark, SF, "documents")
    kept, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert sorted({d for r in out.collect() for d in r.doc_ids}) == sorted(r.doc_id for r in docs.collect())
            break
        assert out.columns == columns
        assert out.dtypes == docs.dtypes
        kept.append(out.count())
        docs = out
    assert all(a > b for a, b in zip(kept, kept[1:]))
    assert simhash.duplicates(docs).count() == 0
    assert decontam.hits(docs, load(spark, SF, "benchmark")).count() == 0
    again = toxicity.train(load(spark, SF, "documents"), load(spark, SF, "labels"))
    assert toxicity.flagged(docs, again).count() == 0
    model = quality.train(load(spark, SF, "documents"), load(spark, SF, "labels"))
    assert quality.scored(docs, model).where("not accepted").count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert got.count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "inkwell").rglob("*.py"):
        if "llm" not in p.parts:
            assert "inkwell.llm" not in p.read_text()


def chained(plan: str) -> list[str]:
    """Python steps of a physical plan that feed another one in the same task."""
    above, got = [], []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        above = [x for x in above if x[0] < depth]
        for _, upper in reversed(above):
            if "Exchange" in upper:
                break
            if name.startswith("MapInArrow") and upper.startswith("MapInArrow"):
                got.append(line)
                break
        above.append((depth, name))
    return got


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans, write = [], Written.__init__

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df, name)

    monkeypatch.setattr(Written, "__init__", noted)
    corpus_pipeline.run(spark, SF)
    assert sum("MapInArrow" in p for p in plans) >= 6
    assert [x for p in plans for x in chained(p)] == []
