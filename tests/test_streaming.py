"""The stream gives what the table gives."""

from __future__ import annotations

from assayer.sources.fixture import qc_results
from assayer.streaming.monitor import flag_counts, flag_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    table = qc_results(spark, SF)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = flag_stream(stream).select("row_id", "RuleFlag").writeStream.format("memory").queryName("flags").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r["row_id"], r["RuleFlag"]) for r in df.collect())
    assert key(spark.table("flags")) == key(flag_stream(table).select("row_id", "RuleFlag"))


def test_windowed_counts(spark, tmp_path):
    table = qc_results(spark, SF)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = flag_counts(flag_stream(stream), "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert spark.table("counts").groupBy().sum("n").first()[0] == flag_stream(table).count()
