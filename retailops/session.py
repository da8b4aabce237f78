"""SparkSession construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "retailops") -> SparkSession:
    """Session tuned for the operators in this package.

    AQE is on so join strategy, partition coalescing and skew splitting are
    decided at runtime from real shuffle sizes; broadcast conversion uses the
    size check of ``spark.sql.autoBroadcastJoinThreshold``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    alone. Only a local session without one (tests, laptop) gets a scratch
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="retailops-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where two jobs must see identical partition contents (range
    partitioning followed by per-partition offsets) and where lost executors
    must not force a recomputation from the source.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever store it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an existing scratch path when the driver ends."""
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.mkdirs(p)
    remove_at_exit(spark, path)
    return path


#: Bytes of the tables below a frame that one bucket stands for (fixed value).
BUCKET_BYTES = 4 << 20


def bucket_count(df: DataFrame) -> int:
    """Buckets by the size of the tables below ``df``: one a core at least, and at most
    ``spark.sql.shuffle.partitions``, which is also taken where a size is not known."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, size // BUCKET_BYTES))


def bucketed_table(df: DataFrame, label: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder, every task's rows in a
    file for each hash bucket of ``keys``, and read it back.

    Groupings on ``keys`` (or more) and joins on them then need no shuffle of these rows,
    and their columns lie packed on disk. The name that Spark wants for a bucketed
    table goes at once, the files when the driver ends.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (df.write.bucketBy(buckets, *keys).option("path", f"{scratch_folder(spark, label)}/table")
       .option("compression", "zstd").format("parquet").saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def shared_table(df: DataFrame, label: str, position: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    For rows that several readers of one query use: each reader then scans only
    its columns, with its filters pushed down, and lost executors cost no
    recomputation from the source. The table is deleted when the driver ends.
    Spark reads large files first; a table so small that one task reads it (no larger
    than the cost of opening a file) has a column ``position``, if named, to sort its rows as written.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark, label)}/table"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if position:
        p, fs = _hadoop_path(spark, path)
        if fs.getContentSummary(p).getLength() <= spark._jsparkSession.sessionState().conf().filesOpenCostInBytes():
            out = out.coalesce(1).select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias(position))
    return out
