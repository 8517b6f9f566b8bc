"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.errors import InvalidArgument

CHECKPOINTS = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> None:
    """The cluster's checkpoint folder holds where it is named; a local session without one (tests) gets a temporary
    one, any other is refused, as its executors do not share the driver's disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get(CHECKPOINTS) or spark.conf.get(CHECKPOINTS, None)
        if not named and not context.master.startswith("local"):
            raise InvalidArgument(f"{CHECKPOINTS} must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def lasting(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation.

    Shuffle files of plans that earlier checkpoints replaced stay on the executors' disks until the driver's
    heap is collected, which a driver with little to do may put off for long; hence the request.
    """
    shared_folder(df.sparkSession)
    df.sparkSession._jvm.System.gc()
    return df.checkpoint()
