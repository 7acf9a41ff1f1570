"""Continuous indexing: files that arrive in a folder are merged into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import embed, jobs
from codeweft.catalog import Catalog
from codeweft.schemas import SCHEMAS


def index_stream(catalog: Catalog, folder: str, provider: embed.Provider, checkpoint: str, **trigger):
    """Index parquet drops of the ``files`` table as they arrive; returns the query.

    Each micro-batch runs the batch job, whose hash check makes a replayed
    batch do nothing twice.
    """
    stream = catalog.spark.readStream.schema(SCHEMAS["files"]).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(
        lambda batch, _: jobs.index_files(catalog, batch, provider)
    ).start()


def commits_per_window(commits: DataFrame, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Commits by project and window of their date; works on streams, with late rows up to ``late``."""
    stream = commits.where("date is not null")
    if commits.isStreaming:
        stream = stream.withWatermark("date", late)
    w = F.window("date", window)
    return stream.groupBy("project", w.alias("w")).agg(F.count("*").alias("commits")).select("project", F.col("w.start").alias("start"), "commits")
