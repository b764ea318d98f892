"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

import lectern
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on; all are runtime-settable, so a cluster session keeps its own
# master, memory and partition count.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parquet looks at the size of pages and row groups after ten rows, not after a hundred: rows may be texts of megabytes
    "parquet.page.size.row.check.min": "10",
    "parquet.block.size.row.check.min": "10",
}


def prepare(spark: SparkSession) -> SparkSession:
    # helpers that run inside tasks travel by value, so executors need no installed copy
    cloudpickle.register_pickle_by_value(lectern)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, name: str = "lectern") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.default.parallelism", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # no call-site capture for every column expression: building plans gets several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        # the shared tables are single files of one row group here: text work is dealt out to all cores on request
        .config("spark.lectern.inputPartitions", str(cpus))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    One under /tmp is set only for a session that runs in this one process and names none; a
    cluster without the setting gets an error, as a local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)  # only what exists can be marked
    files.deleteOnExit(target)
    return path


def written(df: DataFrame, label: str = "table", long_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files: lineage ends here,
    any executor can read them again, and later steps read only the columns they need. ``long_rows``: of texts of up to
    megabytes, in small groups, as a task that reads them holds a whole group (or 4 096 rows) in memory."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("overwrite").options(**{"parquet.block.size": str(16 << 20)} if long_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Needed where a value depends on how rows were placed (block numbers): a recomputed task must
    see the same placement, and the partitions must stay as they are.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
