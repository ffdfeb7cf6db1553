"""The pipeline's stages, each held against its input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lumenspan.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, "12345 !!", None, "s", 8), (9002, None, None, "s", None), (9003, "the and that with for", None, "s", 21)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    counts = []
    for name, stage in cp.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, SF), name)
        assert out.columns == columns
        if name == "language_id":
            assert docs.join(out, "doc_id", "left_anti").count() == 2 and out.where("lang is null").count() == 0
        if name == "simhash_near_dedup":
            assert out.count() == out.select("doc_id").distinct().count()
        if name in ("substring_dedup", "pii"):
            assert out.count() == docs.count()
        if name == "pii":
            assert out.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
        docs = out
        counts.append(out.count())
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert counts == sorted(counts, reverse=True)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


def test_stages_on_an_empty_table_and_on_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = ["predicted", "place", "carried", "block", "kept", "component_id", "spans", "base"]
    for table in (docs.where("false"), docs.where("doc_id < 40").withColumns({c: F.lit(c) for c in clash}).unionByName(docs.where("doc_id = 1").select("doc_id", F.repeat("text", 300).alias("text"), "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in clash]))):
        rows = table.count()
        for name, stage in cp.STAGES[:-1]:
            out = common.materialize(stage(spark, table, SF), name)
            assert out.columns == table.columns and (out.count() > 0) == (rows > 0)
            if rows:
                assert [tuple(r) for r in out.select(*[c for c in clash if c in out.columns]).distinct().collect()] == [tuple(clash)]
            table = out
        packed = cp.STAGES[-1][1](spark, table, SF)
        assert packed.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
