"""Stored tables as snapshots under one root folder.

A write makes a new snapshot directory; readers take the newest one that is
complete (it holds ``_SUCCESS``), so a run that dies leaves the old state.
Tables are partitioned by project; reading one project prunes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import graph, incremental
from codeweft.schemas import KEYS, SCHEMAS


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _snapshots(self, name: str) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(path(p, "_SUCCESS")))

    def read(self, name: str, project: str | None = None) -> DataFrame:
        """The newest snapshot; of one project or, for None, of all. "" is a project."""
        versions = self._snapshots(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{versions[-1]}")
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df = df.withColumn("project", F.coalesce("project", F.lit(""))).select(columns)
        return df if project is None else df.where(F.col("project") == project)

    def write(self, name: str, df: DataFrame) -> None:
        """Make ``df`` the newest snapshot; the one before it is kept for readers."""
        versions = self._snapshots(name)
        target = f"{self.root}/{name}/v{(versions[-1] if versions else 0) + 1}"
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df.select(columns).write.mode("overwrite").partitionBy("project").parquet(target)
        fs, path = self._fs()
        for old in versions[:-1]:
            fs.delete(path(f"{self.root}/{name}/v{old}"), True)

    def setup(self) -> None:
        """Make sure that every table exists."""
        for name, schema in SCHEMAS.items():
            if not self._snapshots(name):
                self.write(name, self.spark.createDataFrame([], schema))

    def upsert(self, name: str, new: DataFrame) -> None:
        """Rows of ``new`` replace those of the same key; commits keep author and date."""
        old = self.read(name)
        new = new.dropDuplicates(KEYS[name])
        merged = incremental.upsert_commits(old, new.select(old.columns)) if name == "git_commits" else incremental.upsert(old, new, KEYS[name])
        self.write(name, merged)

    def replace_files(self, name: str, changed: DataFrame, new: DataFrame, column: str = "file_path") -> None:
        """Rows of changed (project, file_path) are replaced by ``new``."""
        gone = changed.select("project", F.col("file_path").alias(column)).distinct()
        self.write(name, self.read(name).join(gone, ["project", column], "left_anti").unionByName(new.select(self.read(name).columns)))

    def delete(self, name: str, **values) -> int:
        """Delete the rows with these values; how many there were."""
        old = self.read(name)
        left = incremental.delete(old, **values)
        n = old.count() - left.count()
        if n:
            self.write(name, left)
        return n

    def delete_project(self, project: str) -> dict[str, int]:
        """Delete a project from every table; rows deleted by table."""
        return {name: self.delete(name, project=project) for name in SCHEMAS}

    def prune(self) -> None:
        """Drop everything and start with empty tables."""
        fs, path = self._fs()
        for name in SCHEMAS:
            fs.delete(path(f"{self.root}/{name}"), True)
        self.setup()

    def projects(self) -> DataFrame:
        """Projects with their number of vectors and whether they have a graph."""
        counts = self.read("embeddings").groupBy("project").agg(F.count("*").alias("node_count"))
        graphs = self.read("nodes").select("project").distinct().withColumn("g", F.lit(True))
        joined = counts.join(graphs, "project", "full")
        return joined.select("project", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.col("g").isNotNull().alias("has_graph")).orderBy("project")

    def names(self) -> DataFrame:
        """Projects that any table has."""
        out = None
        for name in SCHEMAS:
            part = self.read(name).select("project").distinct()
            out = part if out is None else out.unionByName(part)
        return out.distinct()

    def graph_states(self) -> DataFrame:
        """(project, state) of every project: no graph, an empty graph (files without nodes), or a graph."""
        has = lambda name: self.read(name).select("project").distinct().withColumn(name, F.lit(True))
        joined = self.names().join(has("graph_hashes"), "project", "left").join(has("nodes"), "project", "left")
        state = F.when(F.col("nodes"), "graph").when(F.col("graph_hashes"), "empty graph").otherwise("no graph")
        return joined.select("project", state.alias("state"))

    def file_vertices(self) -> DataFrame:
        """(project, path, hash) of the files in the graph."""
        return graph.file_vertices(self.read("graph_hashes"))
