"""Window rollups over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.metrics import merged_rollups, rollup


def exact_rollup(samples: DataFrame) -> DataFrame:
    """Every sample counts in its own window however late it is; for update or complete mode."""
    return rollup(samples)


def bounded_rollup(samples: DataFrame, ts: str = "event_time", late: str = "65 minutes") -> DataFrame:
    """Five-minute windows with a watermark: bounded state, samples later than ``late`` are dropped."""
    return (
        samples.withWatermark(ts, late).groupBy(F.window(ts, "5 minutes"), "protocol")
        .agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens"))
        .select(F.col("window.start").alias("window_start"), "protocol", "requests", "total_tokens")
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every micro-batch to a folder of its own, so a batch that is run again replaces itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def latest_batches(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key among the batches of an update-mode stream."""
    values = [c for c in stored.columns if c not in (*keys, "batch")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def write_partials(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's own windows as three stored tables in a folder of the batch.

    No state is kept, late samples count in their own window, and a batch that runs again after a crash
    between its write and its commit takes its own place.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rollup(batch).write.mode("overwrite").partitionBy("granularity").parquet(f"{path}/base=-1/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def _current(rows: DataFrame, base: int) -> DataFrame:
    """The base with its number, and the batches behind it."""
    return rows.filter(((F.col("base") == base) & (F.col("base") >= 0)) | ((F.col("base") == -1) & (F.col("batch") > base))).drop("base", "batch")


def stored_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The three tables read back and merged: the newest base, and the batches behind it."""
    rows = spark.read.parquet(path)
    return merged_rollups(_current(rows, rows.agg(F.max("base")).first()[0]))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Merge all up to a batch into one base; reading picks it up once it is there, and again is no harm."""
    rows = spark.read.parquet(path)
    before = rows.filter(F.col("base") < upto).agg(F.max("base")).first()[0]
    merged = merged_rollups(_current(rows.filter(F.col("batch") <= upto), before))
    merged.write.mode("overwrite").partitionBy("granularity").parquet(f"{path}/base={upto}/batch=-1")
