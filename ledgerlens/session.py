"""Session helpers shared by every operator: table access, checkpoints, local sessions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Rows of a large table that a task takes at once: sorted and hashed for joins and aggregates, some 150 MB, or 500 MB where a stage does many of them.
LOT_ROWS = 150_000


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: one for each LOT_ROWS, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LOT_ROWS))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``n`` partitions where these are more than the session's shuffle partitions; else as it is.

    What follows on the same keys (joins, aggregates, windows) stays in these partitions, so that a task's memory does not grow with the input.
    """
    return df.repartition(n, *keys) if n and n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (single-machine tests) is a
    temporary one made.
    """
    checkpoint_folder(df)
    return df.checkpoint(eager=True)


def checkpoint_folder(df: DataFrame) -> str:
    """The session's checkpoint folder, set if it wasn't; tables of a loop's steps can be written there and read again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()
