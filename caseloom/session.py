"""Session settings and the reliable checkpoint used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

# Streaming state on local disk instead of the executor heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows in a file of a table that is trained on, at least.
ROWS_PER_FILE = 10_000


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Cluster sizing stays with spark-submit; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; for local sessions without it one that ends with the process."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="caseloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{checkpoint_root(spark)}/caseloom/{spark.sparkContext.applicationId}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames that read them are of no use afterwards."""
    store, path = pyarrow.fs.FileSystem.from_uri(work_folder(spark))
    if store.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        store.delete_dir(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Later jobs start from the files, so they neither repeat the work nor depend on executors that may be lost, read only
    the columns they use, and know the table's size. ``remove_intermediates`` deletes them when a job is done.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, key: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``materialize`` in files of about ``rows_per_file`` rows or more, dealt out by ``key``, for tables that are trained on.

    A trainer reads its rows in hundreds of passes, and each task sends its statistics in every pass. So the tasks must follow
    from the rows, not from the shuffles before. There are never more files than ``df`` has partitions.
    """
    stored = materialize(df)
    files = max(1, min(stored.count() // rows_per_file, stored.rdd.getNumPartitions()))
    return materialize(stored.repartition(files, key).sortWithinPartitions(key) if key else stored.coalesce(files))
