"""Partitions of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. A table in fewer pieces than that is small and would keep most of
    them idle; one with more, as any large table has, stays as it is, without an exchange. So does what has an exchange already: to
    ask how many partitions that has would run it."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of input, as it is stored, of a piece that a task works on with all that it knows of it.
PIECE = 1 << 24


def pieces(df: DataFrame) -> int:
    """How many pieces to work on df in: as many as there are cores, and more as its files grow, so that none does."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = stored // PIECE + 1 if stored < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(known, df.sparkSession.sparkContext.defaultParallelism)
