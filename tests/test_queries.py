"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.operators import pipeline
from strandloom.plans import catalog
from strandloom.sources.shared import settled

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert len(got) > 0 and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    if os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "strandloom/llm")):
        assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_plans_stay_in_the_jvm(spark):
    for name in ("locus_summary", "best_placement", "flank_pair_search", "read_filter_counters", "ref_phasing_summary", "pileup_rows"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_flanks_settle_equal_reads_once(spark, monkeypatch):
    """What is settled of the reads grows with different reads, not with all of them."""
    kept = []

    def noted(df):
        kept.append(settled(df))
        return kept[-1]

    monkeypatch.setattr(pipeline, "kept_once", noted)
    sides = catalog.QUERIES["flank_side_table"](spark, SF)
    reads = next(df for df in kept if "marks" in df.columns)
    total = sides.where("side = 'upstream'").agg(F.sum("n_reads")).first()[0]
    assert reads.count() * 10 < total == reads.agg(F.sum("weight")).first()[0]
