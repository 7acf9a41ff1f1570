"""Extraction from the given files, and commits by week."""

from pyspark.sql import functions as F

from codeweft.operators import extract, graph
from codeweft.plans.tables import table
from codeweft.streaming.ingest import commits_per_window


def extract_symbols(spark, sf):
    """Symbols of all files."""
    return extract.symbols(table(spark, sf, "files")).drop("body")


def extract_relationships(spark, sf):
    """Unresolved relationships of all files."""
    return extract.relationships(table(spark, sf, "files"))


def extract_graph(spark, sf):
    """Edges between the symbols extracted from the files, by name."""
    files = table(spark, sf, "files")
    nodes = extract.symbols(files).withColumn("node_id", F.xxhash64("project", "kind", "name", "file_path", "start_line"))
    v = graph.without_prototypes(graph.vertices(nodes))
    e = graph.edges(v, graph.links(extract.relationships(files)))
    return e.groupBy("project", "type").agg(F.count("*").alias("edges"))


def extract_agreement(spark, sf):
    """Given nodes by kind and how many of them extraction finds with the same lines."""
    keys = ["project", "file_path", "name", "kind", "start_line", "end_line"]
    given = table(spark, sf, "nodes").select(*keys).distinct()
    known = table(spark, sf, "files").where("content is not null").select("project", "file_path").distinct()
    found = extract.symbols(table(spark, sf, "files")).select(*keys).distinct().withColumn("found", F.lit(1))
    joined = given.join(known, ["project", "file_path"], "left_semi").join(found, keys, "left")
    return joined.groupBy("kind").agg(F.count("*").alias("given"), F.count("found").alias("found"))


def commits_by_week(spark, sf):
    """Commits by project and week of their date."""
    c = table(spark, sf, "git_commits").select("project", "commit_hash", "date").dropDuplicates(["project", "commit_hash"])
    return commits_per_window(c)


QUERIES = {f.__name__: f for f in (extract_symbols, extract_relationships, extract_graph, extract_agreement, commits_by_week)}
SQL = {
    "commits_by_week": """SELECT project, time_bucket(INTERVAL '7 days', date, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS start, count(*) AS commits
FROM (SELECT DISTINCT project, commit_hash, date FROM git_commits WHERE date IS NOT NULL) GROUP BY ALL""",
}
