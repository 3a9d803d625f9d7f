"""Session settings and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEALT = 4000  # texts of a partition that are cut into words

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; master and partitions are left to the cluster unless given."""
    builder = SparkSession.builder.config(map=SETTINGS | conf)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share; a temporary folder only where that is unset and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str, each: int = DEALT, rows: int | None = None) -> DataFrame:
    """The rows dealt by a hash of ``by`` into partitions of some ``each``; what is grouped by ``by`` and more columns after that isn't shuffled again.

    The number of partitions grows with the rows, so a task's memory doesn't;
    ``rows`` is how many there are, where that is known without a count.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if rows is None else rows) // each)), *by)


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; on a cluster ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark
