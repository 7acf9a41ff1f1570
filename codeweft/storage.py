"""Cutting lineage through a folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``).

    Only where the session names none, which is the case in local tests, a
    folder of our own is created and set for the session; never on a cluster,
    whose executors do not share the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The result has no lineage beyond the table, so a lost executor costs one
    re-read; unlike ``checkpoint()`` the table is columnar and compressed, and
    later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/codeweft-" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over enough partitions for work that is heavy for each row.

    A scan makes partitions by bytes, which leaves the cores idle when a row of
    a kilobyte takes milliseconds.
    """
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
