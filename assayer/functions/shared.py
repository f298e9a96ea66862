"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables with more rows than this are not broadcast on purpose.
SMALL = 50_000


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="assayer-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only on a local master (tests, a laptop) is one made where that is unset; on a
    cluster a folder of one machine would break silently, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """Write a reliable checkpoint into the shared folder, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(table: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has SMALL rows at most."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table
