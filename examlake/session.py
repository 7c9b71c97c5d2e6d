"""Session settings this library is tuned for, and where jobs may keep shared files."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # AQE picks partition counts, splits skewed joins and turns small sides into broadcasts by
    # their measured size; nothing in this library forces a broadcast of data that can grow.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    # The JVM never compiles methods over 8000 bytes of bytecode, so wide projections fused into one
    # larger method run interpreted. Above this limit Spark evaluates them operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the call site of every column expression multiplies the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", app: str = "examlake", memory: str = "8g", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="examlake-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
