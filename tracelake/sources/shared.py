"""The folder that all executors share, for cutting the plan of iterative work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read back; a temporary one where none is set and Spark runs locally.

    The shuffle files of that step go at once, not when the driver collects its garbage.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
