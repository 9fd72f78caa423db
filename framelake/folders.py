"""Where intermediate files go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. Where none is set: a temporary one if driver and executors are one process
    (kept for the session), else an error, as executors can't reach a folder of the driver's own."""
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set(SETTING, named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, which survives lost executors, and cut from its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
