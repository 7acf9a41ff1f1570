"""The batch commands: index files, build the graph, index commits, delete, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import embed
from codeweft.catalog import Catalog
from codeweft.functions import text as T
from codeweft.operators import chunks, extract, graph, incremental
from codeweft.storage import materialize

MAX_COMMITS = 500


def changed(catalog: Catalog, files: DataFrame, hashes: str) -> DataFrame:
    """The files whose content is not the one last recorded in the table ``hashes``, with content.

    Indexing (``file_hashes``) and the graph (``graph_hashes``) each keep their own.
    """
    states = incremental.file_states(files, catalog.read(hashes)).where("state = 'changed'").drop("state")
    return materialize(files.where("content is not null").select("project", "file_path", "content").dropDuplicates(["project", "file_path"]).join(states, ["project", "file_path"]))


def index_files(catalog: Catalog, files: DataFrame, provider: embed.Provider) -> int:
    """Chunk and embed changed files; their hashes are recorded once all is written."""
    todo = changed(catalog, files, "file_hashes")
    parts = chunks.chunk_files(todo)
    texts = parts.select(
        "project", F.concat(F.lit("chunk_"), "chunk_index").alias("node_name"), "file_path",
        T.chunk_text(F.col("file_path"), F.col("chunk_index"), F.col("total_chunks"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("text"),
    )
    catalog.replace_files("chunks", todo, parts)
    catalog.replace_files("embeddings", todo, embed.with_vectors(texts, "text", provider))
    catalog.upsert("file_hashes", todo.select("project", "file_path", "hash", F.current_timestamp().alias("last_indexed")))
    return todo.count()


def build_graph(catalog: Catalog, files: DataFrame) -> graph.Graph:
    """Extract all changed files; vertices and edges are derived from all current rows."""
    todo = changed(catalog, files, "graph_hashes")
    nodes = extract.symbols(todo).withColumn("node_id", F.xxhash64("project", "kind", "name", "file_path", "start_line"))
    catalog.replace_files("nodes", todo, nodes)
    catalog.replace_files("raw_relationships", todo, extract.relationships(todo), "source_file_path")
    catalog.upsert("graph_hashes", todo.select("project", "file_path", "hash", F.current_timestamp().alias("last_indexed")))
    return project_graph(catalog)


def project_graph(catalog: Catalog, project: str | None = None) -> graph.Graph:
    """The graph of one project, which must be known, or of all."""
    if project is not None:
        known_project(catalog, project)
    v = graph.without_prototypes(graph.vertices(catalog.read("nodes", project)))
    return graph.Graph(v, graph.edges(v, graph.links(catalog.read("raw_relationships", project))))


def index_commits(catalog: Catalog, commits: DataFrame, provider: embed.Provider, most: int = MAX_COMMITS) -> int:
    """Embed and store the newest ``most`` commits that are not stored yet."""
    fresh = incremental.new_rows(commits, catalog.read("git_commits"), ["project", "commit_hash"]).orderBy("seq").limit(most).drop("seq")
    fresh = materialize(fresh.withColumn("text", T.commit_text(F.col("message"), F.col("files_changed"), F.col("diff_summary"))))
    catalog.upsert("git_commits", embed.with_vectors(fresh, "text", provider))
    return fresh.count()


def known_project(catalog: Catalog, project: str) -> str:
    """``project`` if any table has it, else an error that names those there are."""
    names = catalog.names()
    if names.where(F.col("project") == project).isEmpty():
        some = [r.project for r in names.orderBy("project").limit(50).collect()]
        raise ValueError(f"no project {project!r}; there are: {', '.join(some) or 'none'}")
    return project


def delete_project(catalog: Catalog, project: str, force: bool = False) -> dict[str, int]:
    """Delete a project from every table; it must exist, and ``force`` be given."""
    known_project(catalog, project)
    if not force:
        raise ValueError("deleting a project needs force=True")
    return catalog.delete_project(project)


def prune(catalog: Catalog, force: bool = False) -> None:
    if not force:
        raise ValueError("pruning needs force=True")
    catalog.prune()
