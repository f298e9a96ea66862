"""QC rules on a stream of results: what is local to a row runs unchanged, medians come from a table of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import pipeline


def flag_stream(results: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Limits, deviations and traffic light of every result of a stream (or table).

    `reference` has a `median` by Analyte and SampleType of earlier results, for rows without target and parent; without
    it such rows have no limits but those of the export."""
    df = pipeline.normalise(results)
    if reference is not None:
        known = reference.select("Analyte", "SampleType", F.col("median").alias("__m"))
        df = df.join(known, ["Analyte", "SampleType"], "left")
        df = df.withColumn("ExpectedValue", F.coalesce("ExpectedValue", "ParentValue", "__m")).drop("__m")
    else:
        df = df.withColumn("ExpectedValue", F.coalesce("ExpectedValue", "ParentValue"))
    return pipeline.drop_incomplete(pipeline.derive_limits(df)).transform(pipeline.deviation_features).transform(pipeline.traffic_light)


def flag_counts(flagged: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Flags by analyte in windows of analysis time; results later than `late` behind the newest are not counted."""
    timed = flagged.withColumn("at", F.col("AnalysisDate").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "Analyte", "RuleFlag").agg(F.count(F.lit(1)).alias("n"))
