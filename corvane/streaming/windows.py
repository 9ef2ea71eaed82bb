"""Streaming counterparts of date histograms: event-time windows with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.mapping import Mapping
from corvane.plans.query import Compiler


def open_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def matching(stream: DataFrame, query: dict, properties: dict | None = None) -> DataFrame:
    """A stream's rows that match a query; only queries without joins or statistics."""
    c = Compiler(stream, Mapping(stream, properties), None, False)
    m = c.compile(query)
    return c.df.where(m.hit)


def windowed(stream: DataFrame, time_col: str, size: str, metrics: dict[str, Column], *, slide: str | None = None, gap: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling, sliding (``slide``) or session (``gap``) windows, dropping rows later than the watermark."""
    timed = stream.withColumn("_cv_time", F.col(time_col).cast("timestamp")).withWatermark("_cv_time", late)
    w = F.session_window("_cv_time", gap) if gap else F.window("_cv_time", size, slide) if slide else F.window("_cv_time", size)
    out = timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("doc_count"), *[m.alias(n) for n, m in metrics.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "doc_count", *metrics)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there, written by the executors to a Parquet folder that all share: batches after each other, or in mode complete the last one."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)  # where there is nothing to write
    write = lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
