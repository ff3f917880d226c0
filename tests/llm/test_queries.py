"""The registered queries over the small tables: SQL where there is some, contracts elsewhere."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ampspark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, same_as_sql, name):
    assert same_as_sql(queries.queries()[name], queries.oracle_sql()[name], SMALL) > 0


def test_languages_on_the_held_out_fold(spark):
    got = queries.op10_cross_parsing(spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    assert got.join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op1_quality_rules(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.8


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
    out = corpus_pipeline.run(spark, SMALL)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert out.select("doc_id").distinct().count() > 50
