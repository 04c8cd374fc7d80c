"""Plan checks over every registered query: no cartesian products or cross
joins, and narrow queries read only the columns they need."""

import os
import uuid

import pytest

from sparkpairs.plans.registry import QUERIES
from sparkpairs.sources.html import html_to_markdown
from sparkpairs.streaming.inject import stream_apply

SMALL = "/root/testdata/sf0.001"


#: Joins by a comparison: the histogram of lengths with a grid of at most 31 lengths.
NESTED_LOOPS = {"truncation_curve", "optimal_max_length", "length_advice", "packing_report"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in NESTED_LOOPS


def test_column_pruning(spark):
    plan = QUERIES["word_counts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["best_metric"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan


def test_stream_apply_matches_batch(spark, tmp_out):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    pages.repartition(2).write.parquet(f"{tmp_out}/in")

    def to_md(df):
        return df.select("page_id", html_to_markdown("html").alias("markdown"))

    q = stream_apply(spark, f"{tmp_out}/in", pages.schema, f"{tmp_out}/out", to_md, name=f"md{uuid.uuid4().hex}")
    q.awaitTermination(300)
    got = {(r.page_id, r.markdown) for r in spark.read.parquet(f"{tmp_out}/out").collect()}
    assert got == {(r.page_id, r.markdown) for r in to_md(pages).collect()}
