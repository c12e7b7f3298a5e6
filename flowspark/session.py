"""Session settings every flowspark job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings that operators depend on for correct text or for their plan.
RUNTIME_SETTINGS = {
    # Display times are UTC, whatever machine formats them.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan joins from measured sizes and split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # `row_number() <= n` is pruned before the shuffle up to this n; line caps
    # (2,500 characters hold at most 2,500 lines) need more than the default.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Where the session keeps the name of its run, and of its temporary folder where none is set.
RUN, LOCAL = "flowspark.run", "flowspark.local"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a local test) is a fresh temporary folder used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = spark.conf.get(LOCAL, None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="flowspark-")
        # The setting itself cannot be given to a running session.
        spark.conf.set(LOCAL, folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's intermediates, below the shared one; a new one after `drop_run`."""
    name = spark.conf.get(RUN, None)
    if not name:
        name = f"run-{os.urandom(6).hex()}"
        spark.conf.set(RUN, name)
    return os.path.join(checkpoint_dir(spark), name)


def drop_run(spark: SparkSession) -> None:
    """Delete all intermediates that this session has written; tables read from them end with them.

    For the end of a job, when its results are written elsewhere. What other
    sessions wrote, and files that a sink was given a path for, stay.
    """
    if spark.conf.get(RUN, None):
        place = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        spark.conf.unset(RUN)


def cut_lineage(df, name: str):
    """Write `df` to the run's folder and read it back.

    Used where one expensive result feeds several branches: a lost executor
    then costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = os.path.join(run_folder(spark), f"{name}-{os.urandom(6).hex()}")
    df.write.parquet(path)
    return spark.read.parquet(path)
