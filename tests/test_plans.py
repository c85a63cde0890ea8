"""How the text queries are laid out: who reads the rows, and how often a text is sent to the searches."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gatesift.plans import inputs, registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    """A file of many splits and one row group: one task would read all rows."""
    rows = pa.table({"doc_id": list(range(4000)), "text": [f"{i * 7919} some words " * 20 for i in range(4000)]})
    pq.write_table(rows, tmp_path / "documents.parquet", compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        table = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert table.rdd.getNumPartitions() >= 8
        dealt = inputs.spread(table, "doc_id")
        counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 4000 and len(counts) >= 8 and max(counts) <= 4000 // 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_even_splits_are_left_alone(spark, tmp_path):
    for i in range(8):
        pq.write_table(pa.table({"doc_id": list(range(i * 100, i * 100 + 100)), "text": ["x" * 1000] * 100}), tmp_path / f"{i}.parquet")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")
        table = spark.read.parquet(str(tmp_path))
        assert inputs.spread(table, "doc_id") is table
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["atlas_technique", "violations_by_regulation", "match_ioc", "pattern_pack"])
def test_documents_are_read_and_searched_once(spark, name):
    """One scan of the texts, one step in Python, and no rewritten text on the way back."""
    plan = plan_of(registry.queries()[name](spark, SF))
    assert plan.count("ArrowEvalPython") == 1
    assert sum("text#" in line for line in plan.splitlines() if "Relation [" in line) == 1
    assert ".hits" not in plan
