"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "reviewmill", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter builds the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Session settings the queries rely on.

    ISO strings are written and read as UTC instants, so the session zone has to be UTC. The JVM never
    compiles methods above 8000 bytes of bytecode; with this limit Spark splits such stages instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of the driver gets a folder that goes with the process;
    any other has to name one, as a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        root = context.getCheckpointDir()
    if not root and context.master.startswith("local["):
        root = _own_folder(spark)
    if not root:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def _own_folder(spark: SparkSession) -> str:
    """For a session whose executors are threads of the driver: a folder that goes when the process ends."""
    root = tempfile.mkdtemp(prefix="reviewmill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back.

    The result survives the loss of executors, keeps plans short in loops, and unlike a row checkpoint it
    is columnar and its size is known, so later joins are planned on facts. It is packed closely, and what was
    shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, "stage"), spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(saved: DataFrame) -> None:
    """Delete the files of a table from :func:`cut_lineage` that nothing reads any more."""
    for file in saved.inputFiles()[:1]:
        folder = saved.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(saved.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
