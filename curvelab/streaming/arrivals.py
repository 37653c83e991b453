"""Arriving files: the batch functions on micro-batches, and tumbling curves with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.sources.readers import ACCEPTED
from curvelab.sources.sinks import file_system

COMMITS = "_commits"


def arriving_uploads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of accepted files that appear under a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{" + ",".join(ACCEPTED) + "}").load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Apply a batch function to everything that has arrived, once, and stop."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_sink(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A batch function for ``run_available`` that writes what ``make`` makes of a batch, under the batch's number, and then its number to a commit list.

    A batch that runs again replaces what it wrote before, whether it had ended or not, so each of its rows is there once.
    """

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        make(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        fs, done = file_system(spark, f"{path}/{COMMITS}/{batch}")
        fs.create(done, True).close()

    return each


def committed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all batches that have been written whole; of none, an empty table of ``schema``."""
    fs, folder = file_system(spark, f"{path}/{COMMITS}")
    numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []
    if not numbers:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/batch={n}" for n in numbers])


def window_features(stream: DataFrame, ts: str = "ts", value: str = "value", key: str = "user_id", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per key and tumbling window: n, first argmax and extremes; events later than the watermark are dropped."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"), F.min(value).alias("low"), F.min_by(ts, F.struct(-F.col(value), F.col(ts))).alias("peak_at"))
        .select(key, F.col("window.start").alias("start"), "n", "peak", "low", "peak_at")
    )
