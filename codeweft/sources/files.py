"""Source trees as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.text import project_name
from codeweft.operators.extract import LANGUAGES

# Directories that hold no sources.
EXCLUDED = ["node_modules", ".git", "dist", "target", "build", "out"]


def scan(spark: SparkSession, directory: str, project: str) -> DataFrame:
    """(project, file_path, content, hash) of the source files below a directory.

    Excluded directories are left out at any depth, as are declaration files
    (``.d.ts``) and unknown extensions; paths are filtered before contents are
    read.  Bytes that are not UTF-8 become replacement characters; the hash is
    that of the decoded text.
    """
    root = directory.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    relative = F.regexp_replace("path", "^.*?" + root.replace(".", r"\.") + "/", "")
    folders = "|".join(e.replace(".", r"\.") for e in EXCLUDED)
    kept = raw.withColumn("file_path", relative).where(
        ~F.col("file_path").rlike(f"(^|/)({folders})/") & F.col("file_path").rlike(r"\.(" + "|".join(LANGUAGES) + ")$") & ~F.col("file_path").endswith(".d.ts")
    )
    return kept.select(
        project_name(F.lit(project)).alias("project"), "file_path", F.expr("make_valid_utf8(cast(content as string))").alias("content")
    ).withColumn("hash", F.sha2("content", 256))
