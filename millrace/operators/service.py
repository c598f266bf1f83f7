"""Relational experiment bookkeeping: budgets, fair-share dispatch, submissions, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ACTIVE = ("queued", "running")


def used_budget(status: Column, used: Column, maximum: Column) -> Column:
    """Charge of one experiment: finished ones what they used, at least 1 and at most their
    maximum; active ones their maximum; others nothing."""
    return (
        F.when(status.isin("completed", "failed"), F.least(F.greatest(F.lit(1.0), used), maximum)).when(status.isin(*ACTIVE), maximum).otherwise(0.0)
    )


def budgets(experiments: DataFrame) -> DataFrame:
    """Experiments ``(user, status, used, maximum)`` to one charge a user."""
    return experiments.groupBy("user").agg(F.coalesce(F.sum(used_budget(F.col("status"), F.col("used"), F.col("maximum"))), F.lit(0.0)).alias("charged"))


def fair_dispatch(experiments: DataFrame, slots: int) -> DataFrame:
    """Queued experiments to start now, in order, with the number that runs.

    A user's k-th queued experiment ranks by k plus the user's running count; ties go to
    the earlier queue time and id. As many start as slots are free; with none free the
    running count is reported alone. The free slots bound the global order, so it is a
    top-k and not a window over everything.
    """
    running = experiments.where("status = 'running'").groupBy("user").agg(F.count("*").alias("n_running"))
    total = experiments.where("status = 'running'").agg(F.count("*").alias("running")).withColumn("free", F.greatest(F.lit(slots) - F.col("running"), F.lit(0)))
    own = Window.partitionBy("user").orderBy("queued_at", "id")
    queued = experiments.where("status = 'queued'").withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= slots)
    ranked = queued.join(running, "user", "left").withColumn("share", F.col("rn") + F.coalesce("n_running", F.lit(0)) - 1)
    chosen = ranked.orderBy("share", "queued_at", "id").limit(slots).select("id", "user", "share", "queued_at")
    place = Window.orderBy("share", "queued_at", "id")
    placed = chosen.withColumn("position", F.row_number().over(place))  # at most ``slots`` rows
    return total.join(placed, placed["position"] <= total["free"], "left").select("running", "position", "id", "user")


def duplicate_guard(new: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that may be inserted: their key is not held yet, and the first of the new ones."""
    first = Window.partitionBy(*keys).orderBy("id")
    fresh = new.join(held.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """``(id, rule)`` for each rule that a row breaks; a null outcome breaks it too."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(id_col, F.explode(broken).alias("rule"))


def transitions(events: DataFrame) -> DataFrame:
    """Each event of an entity with the state before it, and whether the step is legal:
    queued to running, running to completed or failed."""
    order = Window.partitionBy("entity").orderBy("at", "id")
    before = F.coalesce(F.lag("state").over(order), F.lit("new"))
    legal = F.concat_ws(">", before, F.col("state")).isin("new>queued", "queued>running", "running>completed", "running>failed")
    return events.select("id", "entity", "at", "state", before.alias("before"), legal.alias("legal"))
