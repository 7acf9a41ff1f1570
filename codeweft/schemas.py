"""Schemas of the stored tables and their keys."""

SCHEMAS = {
    "files": "project string, file_path string, content string, hash string",
    "file_hashes": "project string, file_path string, hash string, last_indexed timestamp",
    "graph_hashes": "project string, file_path string, hash string, last_indexed timestamp",
    "chunks": "project string, file_path string, chunk_index int, total_chunks int, content string, start_line int, end_line int",
    "nodes": "project string, node_id bigint, file_path string, name string, kind string, signature string, body string, start_line int, end_line int",
    "raw_relationships": "project string, source_file_path string, source_name string, source_kind string, target_name string, target_kind string, relationship_kind string",
    "embeddings": "project string, node_name string, file_path string, embedding array<float>",
    "git_commits": "project string, commit_hash string, author string, date timestamp, message string, files_changed string, diff_summary string, embedding array<float>",
}
KEYS = {"file_hashes": ["project", "file_path"], "graph_hashes": ["project", "file_path"], "embeddings": ["project", "node_name", "file_path"], "git_commits": ["project", "commit_hash"]}
