"""Event streams: windows, sessions, de-duplication, and the experiment state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = {("new", "queued"), ("queued", "running"), ("running", "completed"), ("running", "failed")}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with a timestamp fit for watermarks."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """An entity's rows of one batch by time and id. Spark hands them over in parts, cut where an
    Arrow batch ends, and rows of a later part may come before those of an earlier one."""
    return pd.concat(list(parts), ignore_index=True).sort_values(["at", "id"])


def state_machine(events: DataFrame) -> DataFrame:
    """Events ``(id, entity, at, state)`` with the state before and whether the step is
    legal; an illegal step is reported and leaves the state as it was. State is one word an entity."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get[0] if held.exists else "new"
        rows = []
        for r in in_order(parts).itertuples(index=False):
            legal = (state, r.state) in STEPS
            rows.append((r.id, key[0], r.state, state, legal))
            state = r.state if legal else state
        held.update((state,))
        yield pd.DataFrame(rows, columns=["id", "entity", "state", "before", "legal"])

    return events.groupBy("entity").applyInPandasWithState(run, "id long, entity long, state string, before string, legal boolean", "state string", "append", "NoTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is into Parquet files and give these as a table.

    In append mode rows go to the file sink; in complete mode each batch replaces the table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
