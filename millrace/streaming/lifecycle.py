"""Streams of experiment events: an event log with heartbeats and timeouts, the lifecycle of runs,
a dispatcher, and a metrics log. Results go to files, and state has an end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming.events import in_order

STEPS = {("new", "queued"), ("queued", "running"), ("running", "completed"), ("running", "failed")}
ENDED = ("completed", "failed")


def arrived(events: DataFrame) -> DataFrame:
    """The event log: rows as they come with the time at which they were taken in."""
    return events.withColumn("created_at", F.current_timestamp())


def to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over all there is into Parquet files; a restart goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_lifecycle(events: DataFrame) -> DataFrame:
    """Events ``(id, entity, at, kind, run_id, value)`` in order to rows ``(id, entity, kind, before, accepted)``.

    Kinds are the states and ``val_loss``. A step that ``STEPS`` lacks is reported and changes
    nothing; ``running`` sets the run, and ``val_loss`` counts only while that very run is
    running. Of an ended experiment only two words are kept."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, own = held.get if held.exists else ("new", "")
        out = []
        for r in in_order(parts).itertuples(index=False):
            if r.kind == "val_loss":
                ok, after = state == "running" and r.run_id == own, state
            else:
                ok = (state, r.kind) in STEPS and (r.kind not in ENDED or r.run_id == own)
                after = r.kind if ok else state
            out.append((r.id, key[0], r.kind, state, bool(ok)))
            own = r.run_id if ok and r.kind == "running" else own
            state = after
        held.update((state, own or ""))
        yield pd.DataFrame(out, columns=["id", "entity", "kind", "before", "accepted"])

    return events.groupBy("entity").applyInPandasWithState(run, "id long, entity long, kind string, before string, accepted boolean", "state string, run_id string", "append", "NoTimeout")


def silent_runs(heartbeats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Heartbeats ``(entity, at, max_seconds)``: ``(entity, last_beat, deadline)`` of runs that have not
    been heard of for 1.05 times their maximum and 10 seconds, in event time; their state then goes."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        columns = ["entity", "last_beat", "deadline"]
        if held.hasTimedOut:
            last, deadline = held.get
            held.remove()
            yield pd.DataFrame([(key[0], last, deadline)], columns=columns)
            return
        last, deadline = held.get if held.exists else (0, 0)
        for part in parts:
            ms = part["at"].astype("datetime64[ms]").astype("int64")
            grace = (part["max_seconds"] * 1050 + 10_000).astype("int64")
            last, deadline = max(last, int(ms.max())), max(deadline, int((ms + grace).max()))
        held.update((last, deadline))
        if deadline > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(deadline)
        else:
            held.remove()
            yield pd.DataFrame([(key[0], last, deadline)], columns=columns)

    beats = heartbeats.withWatermark("at", late)
    return beats.groupBy("entity").applyInPandasWithState(run, "entity long, last_beat long, deadline long", "last_beat long, deadline long", "append", "EventTimeTimeout")


LEDGER = "id long, key string, outcome string, error string"


def dispatch(
    ticks: DataFrame, pick: Callable[[SparkSession, DataFrame], DataFrame], start: Callable[[dict, str], None], ledger: str, checkpoint: str, every: str | None = None
):
    """A query that at each tick starts what ``pick`` chooses: rows with an ``id`` and more, as many as slots are free.

    ``ledger`` is a folder of claims and outcomes, which ``pick`` gets as a table (``read_ledger``). A
    tick first writes what it claims and only then starts it, each under a key that its id
    decides; what came of it is written after each start. A tick that is repeated after a
    loss does not choose again: it takes up its own claims and starts those without an
    outcome, under the same key, by which ``start`` can tell a repetition from a second
    start. Ids with a claim or an outcome, failed ones included, are not chosen again. The
    choice is small by nature: free slots bound it."""

    def tick(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        claims = f"{ledger}/claims/tick={number}"
        known = read_ledger(spark, ledger)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{claims}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            chosen = pick(spark, known).join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])
            chosen.withColumn("key", F.concat(F.lit("start-"), F.col("id").cast("string"))).write.mode("overwrite").parquet(claims)
        own = spark.read.parquet(claims)
        done = known.where("outcome is not null").select("id")
        for row in own.join(done, "id", "left_anti").orderBy("id").collect():
            told = row.asDict()
            key, outcome, error = told.pop("key"), "started", None
            try:
                start(told, key)
            except Exception as e:  # one experiment's failure must not stop the others
                outcome, error = "failed", repr(e)
            spark.createDataFrame([(row["id"], key, outcome, error)], LEDGER).write.mode("overwrite").parquet(f"{ledger}/outcomes/id={row['id']}-")

    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``(id, key, outcome, error)`` of all that was claimed; the outcome is null until there is one."""

    def table(name: str, schema: str) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{ledger}/{name}")

    outcomes = table("outcomes", LEDGER).drop("key")
    return table("claims", "id long, key string").join(outcomes, "id", "left")


def log_metrics(metrics: DataFrame, path: str, checkpoint: str):
    """A stream of metric rows appended as JSON lines; a restart repeats none."""
    return metrics.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
