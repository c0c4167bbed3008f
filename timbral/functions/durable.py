"""Tables that several passes read, computed once and kept where every executor finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir; where that is unset, in one beside the warehouse's tables."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(own or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()
