"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import getpass
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the cluster; one of its own where none is set and Spark runs locally."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"/tmp/checkpoints/{getpass.getuser()}"
    context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are begun and ended within give their shuffle files back at once, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor costs no recomputation; its shuffle files go."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, removed when the application ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: like ``cut``, and packed by column."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and the folder, which ``removed`` takes once nothing reads it any more."""
    folder = shared_folder(df.sparkSession, "table") + "/rows"
    with shuffles_freed(df.sparkSession):
        df.select("*").write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def untaken(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until none of ``columns`` has it, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_columns_only(df: DataFrame, *names: str) -> DataFrame:
    """Select exactly ``names`` (extra columns of the input, whatever their names, are left out)."""
    return df.select(*[df[name] for name in names])
