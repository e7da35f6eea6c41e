"""Session helpers: reliable checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

THREADS = 8  # jobs that the driver hands out at a time


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the cluster names, else a scratch one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and go on from there.

    Cuts the lineage like a checkpoint and survives lost executors, and as Parquet it keeps column pruning
    and the sizes that join planning needs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join with a table that grows like it: always by shuffle, never by broadcast.

    Spark takes the compressed size of stored tables for their size and an exploded row for one, so it would send tables
    with some rows for every cell through the driver.
    """
    return df.hint("merge")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], most: int = THREADS) -> list:
    """Results of independent jobs, in their order; their Spark jobs share the cluster instead of waiting for each other.

    A fit is a row of short stages, each of which leaves most cores idle at its end and while the driver plans the next.
    ``most`` of them go on at a time (one at least), for jobs that keep much in memory.
    """
    ensure_checkpoint_dir(spark)  # once, before threads could set it twice
    with ThreadPoolExecutor(max(1, min(most, THREADS))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
