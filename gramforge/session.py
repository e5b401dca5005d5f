"""Session helpers: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset, as in local tests, one of our own is set."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "gramforge-checkpoints")
    context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder now and read from there: it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(*makes: Callable[[], T]) -> list[T]:
    """Results of independent functions that run Spark jobs, made at the same time: small stages of one fill the cores that
    another leaves free."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(m)) for m in makes]]


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session has cores.

    A small file is one partition; work on its rows would then be one task.  Larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
