"""Incremental labelling intake, continuous progress and call rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codescout.functions.text import file_safe
from codescout.operators.labels import labelling_progress

INTAKE_SCHEMA = "specialty string, query string"
QUEUE_SCHEMA = INTAKE_SCHEMA + ", status string, attempts int, batch long"


def incremental_labelling_intake(spark: SparkSession, source: str, queue: str, checkpoint: str) -> StreamingQuery:
    """Turn new input files into pending work items, each (specialty, query) once.

    Runs over what has arrived and stops; the next run goes on from the checkpoint. The stream keeps no state: what a batch brings is
    held against the queue itself, by an anti-join. Every batch has a folder of its own in the queue, named by its number, so a
    batch that is repeated after a failure replaces what it had written and adds nothing.
    """
    arrivals = spark.readStream.schema(INTAKE_SCHEMA).json(source)
    items = arrivals.select(file_safe(F.col("specialty")).alias("specialty"), "query")

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.distinct()
        if number:
            earlier = session.read.schema(QUEUE_SCHEMA).parquet(queue).filter(F.col("batch") < number)
            same = new["specialty"].eqNullSafe(earlier["specialty"]) & new["query"].eqNullSafe(earlier["query"])
            new = new.join(earlier, same, "left_anti")
        pending = new.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
        pending.write.mode("overwrite").parquet(f"{queue}/batch={number}")

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_queue(spark: SparkSession, queue: str) -> DataFrame:
    """The work items of all batches."""
    return spark.read.schema(QUEUE_SCHEMA).parquet(queue).drop("batch")


def streaming_progress(items: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Progress per specialty, brought up to date with every batch of work items.

    Each batch replaces the report in ``target`` by the complete totals.
    """

    def replace(report: DataFrame, _: int) -> None:
        report.write.mode("overwrite").parquet(target)

    return (
        labelling_progress(items)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streaming_call_rate(
    calls: DataFrame,
    period: str = "60 seconds",
    slide: str = "10 seconds",
    late: str = "60 seconds",
    caller: str = "caller",
    ts: str = "ts",
) -> DataFrame:
    """Calls per caller in sliding event-time windows; calls later than ``late`` are dropped.

    Works on a stream and on a finished table alike.
    """
    windowed = (
        calls.withWatermark(ts, late)
        .groupBy(caller, F.window(ts, period, slide))
        .agg(F.count("*").alias("calls"))
    )
    return windowed.select(
        caller, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "calls"
    )


def write_call_rates(rates: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the windows of :func:`streaming_call_rate` that are closed, each once.

    A window is closed when the watermark has passed its end; it then leaves the state, so the state holds the open windows only and
    late calls for closed ones are dropped. The parquet sink commits the files of a batch together, so a repeated batch adds nothing.
    Runs over what has arrived and stops; the next run goes on from the checkpoint.
    """
    return (
        rates.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
