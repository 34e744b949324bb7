"""Session settings the jobs are tuned for, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot site keeps its join split even when the aggregate above would have
    # reused the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pages are big rows: keep Arrow batches small, in rows and in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "linkloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    local = os.path.join(tempfile.gettempdir(), f"linkloom-{context.applicationId}")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


# Folders handed out in this process and not yet removed, and the tables that lie in some.
_handed_out: list[str] = []
_tables: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; ``clean_up`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def clean_up(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove the intermediate tables of this process, once results are written.

    Frames that were read from them are of no use afterwards.
    """
    java = spark.sparkContext._jvm
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _handed_out if p not in keep]:
        place = java.org.apache.hadoop.fs.Path(path)
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        place.getFileSystem(settings).delete(place, True)
        _handed_out.remove(path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of any executor, and later plans start
    from a scan with known sizes instead of the whole history of the frame.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done.

    The engine removes them once its driver has collected what referred to them, which on a driver with
    memory to spare can take longer than a chain of big jobs has disk for.
    """
    spark.sparkContext._jvm.System.gc()


def bucket_table(spark: SparkSession, name: str) -> str:
    """Name of a table for ``add_to_buckets`` in the shared folder; ``clean_up`` removes it."""
    path = shared_path(spark, name)
    _tables[path] = f"cut_{uuid.uuid4().hex}"
    return _tables[path]


def add_to_buckets(df: DataFrame, table: str, keys: list[str], shuffle: bool = True) -> DataFrame:
    """Add rows to a table, dealt out by ``keys``, and return the whole of it.

    Without a shuffle each task writes a file for each bucket it has rows of: right for few, big rows.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = next(p for p, t in _tables.items() if t == table)
    dealt = df.repartition(buckets, *keys) if shuffle else df
    dealt.write.mode("append").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def cut_into_buckets(df: DataFrame, name: str, keys: list[str], shuffle: bool = True) -> DataFrame:
    """``cut_lineage`` with rows dealt out by ``keys``: joins and groupings on them move
    only what they are joined with. There are as many buckets as a shuffle has partitions."""
    return add_to_buckets(df, bucket_table(df.sparkSession, name), keys, shuffle)
