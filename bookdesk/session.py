"""Session helpers.

Operators never change session configuration; these helpers are for
entry points (tests, bench, examples) that own the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at cluster scale. AQE re-plans joins from runtime
# sizes, splits skewed shuffle partitions and coalesces small ones; the
# forced skew-join lets AQE split a hot join key even when a later
# aggregate then needs one more (partial-aggregated, hence small) shuffle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (≈1000 executors, ~100 TB of input);
# applied by ``build_session(cluster=True)``, never by the operators.
# Many initial shuffle partitions + AQE coalescing to ~256 MB keeps every
# reducer within executor memory at full scale and still merges small ones;
# 512 MB scan splits keep task counts manageable on 100 TB of parquet.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # size estimates come from compressed file sizes; scale them so a side that
    # passes a broadcast check is bounded in memory too
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.windowExec.buffer.spill.threshold": "1048576",
    "spark.sql.sortMergeJoinExec.buffer.spill.threshold": "1048576",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int = 8,
                  app: str = "bookdesk", extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """Local session for tests and benchmarks; ``cluster=True`` (with
    ``master=None``, taken from spark-submit) applies CLUSTER_CONF."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    else:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("BOOKDESK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is
    unset (local tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="bookdesk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, read again. Unlike a checkpoint
    it forgets how the rows were dealt: a join with it shuffles them anew, so Spark can
    split a hot key of the other side, and its size is known from its files."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, or from
    what ``--py-files`` ships where that place does not exist."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
