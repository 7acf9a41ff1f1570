"""Commit history: parsing a log dump, and a data source that runs git."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft.functions.text import strip, without_binary

# What separates commits and fields in a dump.
COMMIT, FIELD = "---COMMIT_DELIMITER---", "---FIELD_DELIMITER---"
FORMAT = FIELD.join(["%H", "%an", "%aI", "%s", "%b"]) + COMMIT


def read_log(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Commits of a ``git log`` dump in :data:`FORMAT`: project, commit_hash, author, date, message, seq.

    Records of fewer than four fields are skipped; the message is the subject
    and, after an empty line, the body if there is one.
    """
    raw = spark.read.option("lineSep", COMMIT).text(path)
    return parse_log(raw, project)


def parse_log(raw: DataFrame, project: str) -> DataFrame:
    f = F.split(strip(F.col("value")), FIELD, -1)
    body = strip(F.array_join(F.slice(F.col("f"), 5, 1 << 20), ""))
    subject = strip(F.col("f")[3])
    return (
        raw.select(f.alias("f"), F.monotonically_increasing_id().alias("seq")).where(F.size("f") >= 4)
        .select(
            F.lit(project).alias("project"), F.col("f")[0].alias("commit_hash"), F.col("f")[1].alias("author"), F.to_timestamp(F.col("f")[2]).alias("date"),
            F.when(body != "", F.concat(subject, F.lit("\n\n"), body)).otherwise(subject).alias("message"), "seq",
        )
    )


class _Range(InputPartition):
    def __init__(self, start, end):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("commitsPerPartition", 500))
        if not os.path.exists(os.path.join(self.path, ".git")):
            raise ValueError(f"Not a git repository: {self.path}")

    def _git(self, *args):
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""

    def partitions(self):
        n = int(self._git("rev-list", "--count", "HEAD").strip() or 0)
        return [_Range(i, i + self.size) for i in range(0, n, self.size)] or [_Range(0, 0)]

    def read(self, partition):
        import json

        if partition.end == partition.start:
            return
        log = self._git("log", f"--format={FORMAT}", "--no-color", f"--skip={partition.start}", f"--max-count={partition.end - partition.start}")
        for seq, record in enumerate(r for r in log.split(COMMIT) if r.strip()):
            fields = record.strip().split(FIELD)
            if len(fields) < 4:
                continue
            names = self._git("show", "--name-only", "--format=", fields[0]).split("\n")
            diff = self._git("show", "--stat", "--format=", fields[0])
            yield record, json.dumps([x for x in names if x]), diff.strip(), partition.start + seq


class GitLog(DataSource):
    """``spark.read.format("gitlog").load(path)``: value, files_changed, diff, seq of each commit."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "value string, files_changed string, diff string, seq bigint"

    def reader(self, schema):
        return _Reader(self.options)


def read_repository(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Commits of a repository, newest first by ``seq``; partitions are ranges of commits."""
    spark.dataSource.register(GitLog)
    raw = spark.read.format("gitlog").load(path)
    parsed = parse_log(raw.drop("seq"), project).drop("seq")
    more = raw.select(F.split(strip(F.col("value")), FIELD, -1)[0].alias("commit_hash"), "files_changed", without_binary(F.col("diff")).alias("diff_summary"), "seq")
    return parsed.join(more, "commit_hash")
