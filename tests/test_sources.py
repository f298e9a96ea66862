"""Exports by lines, inferred types, unreadable lines, and the typed layer."""

from __future__ import annotations

import datetime
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.sources.exports import BOOLEAN, DOUBLE, LONG, STRING, TIME, infer_types, join_of, read_export
from assayer.sources.layer import YEAR, publish, read_layer, save_bucketed


@pytest.fixture
def export(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('﻿ANALYTE_CODE,NUMERIC_FINAL_VALUE,LOT,SHARE,OK,SEEN,NOTE\nCU,1.5,7,1,True,2024-01-05,"a, ""b"""\nZN,<2,8,0.25,False,05/02/2024,x\n\nCU,2\nFE,3,9,NA,true,2024-01-05 10:00:00,\n')
    (tmp_path / "in" / "b.csv").write_text("NOTE,NUMERIC_FINAL_VALUE,ANALYTE_CODE,LOT,MORE\n" + "".join(f"n{i},{i},CU,{i},{'x' if i == 700 else i}\n" for i in range(2_000)) + "n,1,CU,2,3,4\n")
    return str(tmp_path / "in")


def test_headers_by_name_types_and_unreadable_lines(spark, export):
    got = read_export(spark, export)
    assert got.types == {"ANALYTE_CODE": "string", "NUMERIC_FINAL_VALUE": "double", "LOT": "bigint", "SHARE": "double", "OK": "boolean", "SEEN": "timestamp_ntz", "NOTE": "string", "MORE": "string"}
    rows = {r["row_id"]: r for r in got.rows.collect()}
    assert (rows[0]["NOTE"], rows[0]["LOT"], rows[0]["SHARE"], rows[0]["OK"], rows[1]["NUMERIC_FINAL_VALUE"]) == ('a, "b"', 7, 1.0, True, None)
    assert rows[1]["SEEN"] == datetime.datetime(2024, 2, 5) and rows[3]["SHARE"] is None and rows[3]["NOTE"] is None
    assert all((rows[4 + i]["NOTE"], rows[4 + i]["LOT"], rows[4 + i]["SHARE"]) == (f"n{i}", i, None) for i in range(2_000))
    bad = {r["row_id"]: (os.path.basename(r["file"]), r["line"]) for r in got.unreadable.collect()}
    assert bad == {2: ("a.csv", "CU,2"), 2_004: ("b.csv", "n,1,CU,2,3,4")}
    assert sorted([*rows, *bad]) == list(range(2_005))


def test_numbers_do_not_depend_on_partitions(spark, export):
    plain = {r["row_id"]: r["NOTE"] for r in read_export(spark, export, ["NOTE"]).rows.collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
        spark.conf.set("spark.sql.files.openCostInBytes", "100b")
        small = read_export(spark, export, ["NOTE"]).rows
        assert small.rdd.getNumPartitions() > 20
        assert {r["row_id"]: r["NOTE"] for r in small.collect()} == plain
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_columns_missing_tokens_and_own_row_ids(spark, tmp_path):
    (tmp_path / "x.csv").write_text("row_id,CODE,V\n5,NA,1\n9,nan,-\n")
    got = read_export(spark, str(tmp_path / "x.csv"), ["row_id", "CODE"], {"CODE": ("",)})
    assert sorted(map(tuple, got.rows.collect())) == [(5, "NA"), (9, "nan")]
    with pytest.raises(ValueError, match="NO_SUCH"):
        read_export(spark, str(tmp_path / "x.csv"), ["NO_SUCH"])
    (tmp_path / "h.csv").write_text("A,B\n")
    assert read_export(spark, str(tmp_path / "h.csv")).rows.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, BOOLEAN, LONG, DOUBLE, TIME, STRING]), max_size=6))
def test_join_of_kinds_is_one_lattice(kinds):
    whole = 0
    for k in kinds:
        whole |= k
    seen = set(kinds) - {0}
    want = "double" if not seen or seen in ({DOUBLE}, {LONG, DOUBLE}) else "bigint" if seen == {LONG} else "boolean" if seen == {BOOLEAN} else "timestamp_ntz" if seen == {TIME} else "string"
    assert join_of(whole) == want


def test_inference_reads_all_values(spark):
    df = spark.range(5_000).select(F.when(F.col("id") == 4_321, "1.5").otherwise(F.col("id").cast("string")).alias("a"), F.when(F.col("id") != 7, "True").alias("b"), F.lit(None).cast("string").alias("c"))
    assert infer_types(df.repartition(9), ["a", "b", "c"]) == {"a": "double", "b": "boolean", "c": "double"}


def dated(spark, rows):
    return spark.createDataFrame(rows, "row_id long, ANALYSED_DATE string, v double").withColumn("ANALYSED_DATE", F.col("ANALYSED_DATE").cast("timestamp_ntz"))


def test_layer_replaces_years_and_prunes(spark, tmp_path):
    path = str(tmp_path / "layer")
    assert publish(dated(spark, [(1, "2023-05-01", 1.0), (2, "2024-01-01", 2.0), (3, "2024-12-31 23:59:59", 3.0), (4, None, 4.0)]), path) == 1
    assert publish(dated(spark, [(5, "2024-06-01", 5.0), (6, "2025-01-01", 6.0)]), path) == 2
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    assert ids(read_layer(spark, path)) == [1, 4, 5, 6]
    of_2024 = read_layer(spark, path, [2024])
    assert ids(of_2024) == [5] and YEAR in of_2024.columns
    plan = of_2024._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"{YEAR}#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert publish(dated(spark, [(7, None, 7.0)]), path) == 3 and ids(read_layer(spark, path)) == [1, 5, 6, 7]


def test_failed_publish_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "layer")
    publish(dated(spark, [(1, "2024-05-01", 1.0)]), path)
    broken = dated(spark, [(2, "2024-05-01", 2.0), (3, "2024-05-02", 3.0)]).withColumn("v", F.when(F.col("row_id") == 3, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken row"):
        publish(broken, path)
    assert [r["row_id"] for r in read_layer(spark, path).collect()] == [1]
    assert publish(dated(spark, [(9, "2024-05-01", 9.0)]), path) == 2
    assert [r["row_id"] for r in read_layer(spark, path).collect()] == [9]


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    a = save_bucketed(spark.range(1_000).select("id", (F.col("id") * 2).alias("x")), str(tmp_path / "a"), "id", 4)
    b = save_bucketed(spark.range(0, 1_000, 3).select("id", F.lit(True).alias("hit")), str(tmp_path / "b"), "id", 4)
    joined = a.hint("merge").join(b, "id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.filter("hit").count() == 334 and joined.count() == 1_000


def test_nothing_is_published(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        read_layer(spark, str(tmp_path / "none"))
