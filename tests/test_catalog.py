"""Every registered query of the core against its SQL on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import rules
from colloquy.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    rel = duck.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    at = [cols.index(c) for c in df.columns]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected


def test_entry(spark, small):
    df = catalog.queries()["corpus_summary"](spark, small)
    assert df.columns == ["n_context", "n_samples", "n_chars"]
    assert df.count() > 0


def test_stutter_is_flagged_and_costs(spark, small, tmp_path):
    """Against brute force on both texts of every row."""
    rows = spark.read.parquet(f"{small}/sft_train.parquet")
    ids = [r["id"] for r in rows.select("id").distinct().orderBy("id").limit(20).collect()]
    said = F.concat(F.col("meta.source_prompt"), F.lit("什么时候到货" * 3))
    rows.withColumn("meta", F.when(F.col("id").isin(ids), F.col("meta").withField("source_prompt", said)).otherwise(F.col("meta"))).write.parquet(f"{tmp_path}/sft_train.parquet")
    stutter = re.compile(r"(.{3,24})\1{2}|(.)\2{5}|(.{2})\3{5}", re.S)
    got = catalog.judged(spark, str(tmp_path)).select("id", "q.reason", T.loose_key(F.col("p")).alias("p"), T.loose_key(F.col("r")).alias("r")).collect()
    expected = {x["id"] for x in got if x["reason"] is None and (stutter.search(x["p"]) or stutter.search(x["r"]))}
    flags = {r["id"]: r["flags"].split(",") for r in catalog.queries()["quality_flags"](spark, str(tmp_path)).collect()}
    assert {i for i, f in flags.items() if "stutter_rewrite" in f} == expected and len(expected) > 5
    costs = rules.PENALTIES | {"unknown_intent": 1.0}
    lengths = {r["id"]: (r["a"], r["b"], r["h"]) for r in catalog.judged(spark, str(tmp_path)).select("id", T.compact_length(F.col("p")).alias("a"), T.compact_length(F.col("r")).alias("b"), (F.col("m") > 2).alias("h")).collect()}
    for r in catalog.queries()["candidate_score"](spark, str(tmp_path)).collect():
        a, b, h = lengths[r["id"]]
        points = 3 * (6 <= a <= 80) + 4 * (18 <= b <= 180) + bool(h)
        assert r["score"] == pytest.approx(points - sum(costs.get(f, 0) for f in flags[r["id"]]))
