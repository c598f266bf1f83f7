"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows, on at least as many tasks as there are cores.

    A table of fewer files than cores is dealt anew: a small file is one task's, whatever
    is done to its rows. Tables of more files are read where they are split."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df  # the files are counted where they are listed
