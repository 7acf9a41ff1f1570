"""Queries on the property graph, on what changed, on texts and on vectors, with their SQL."""

from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators import chunks, graph, incremental, search
from codeweft.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _strip(c):
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _label(c):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.LABELS.items())
    return f"CASE {c} {cases} ELSE 'Function' END"


V = f"""v AS (
  SELECT DISTINCT coalesce(project, '') AS project, node_id, {_label('kind')} AS label, coalesce(name, '') AS name, coalesce(file_path, '') AS file_path,
    coalesce(kind, 'function') AS kind, coalesce(signature, '') AS signature, coalesce(body, '') AS body,
    coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line
  FROM nodes WHERE node_id IS NOT NULL)"""
L = f"""l AS (
  SELECT DISTINCT * FROM (
    SELECT coalesce(project, '') AS project, source_file_path, {_strip('source_name')} AS source_name, {_strip('source_kind')} AS source_kind,
      {_strip('target_name')} AS target_name, {_strip('target_kind')} AS target_kind, upper({_strip('relationship_kind')}) AS type FROM raw_relationships)
  WHERE source_name <> '' AND target_name <> '' AND type <> '')"""
E = f"""{V}, {L}, e AS (
  SELECT DISTINCT a.project, a.node_id AS src_id, b.node_id AS dst_id, l.type
  FROM l JOIN v a ON a.project = l.project AND a.name = l.source_name AND a.label = {_label('l.source_kind')}
  JOIN v b ON b.project = l.project AND b.name = l.target_name AND b.label = {_label('l.target_kind')})"""
H = E + """, h AS (
  SELECT e.project, e.type, e.src_id, e.dst_id, a.name AS a_name, a.file_path AS a_file, a.kind AS a_kind, a.label AS a_label,
    b.name AS b_name, b.file_path AS b_file, b.kind AS b_kind, b.label AS b_label
  FROM e JOIN v a ON a.node_id = e.src_id AND a.project = e.project JOIN v b ON b.node_id = e.dst_id AND b.project = e.project)"""


def vertices_of(spark, sf):
    return graph.vertices(table(spark, sf, "nodes"))


def graph_of(spark, sf):
    v = vertices_of(spark, sf)
    return graph.Graph(v, graph.edges(v, graph.links(table(spark, sf, "raw_relationships"))))


# -- the graph and the tools on it


@query(f"WITH {V} SELECT project, label, kind, count(*) AS n, sum(end_line - start_line + 1) AS lines FROM v GROUP BY ALL")
def vertex_counts(spark, sf):
    """Vertices and lines by project, label and kind."""
    return vertices_of(spark, sf).groupBy("project", "label", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


@query(f"WITH {E} SELECT project, src_id, dst_id, type FROM e")
def edge_resolution(spark, sf):
    """Every edge that the relationships name."""
    return graph_of(spark, sf).e


@query(f"""WITH {V} SELECT c.project, c.node_count, g.project IS NOT NULL AS has_graph
FROM (SELECT coalesce(project, '') AS project, count(DISTINCT vec_id) AS node_count FROM code_vectors GROUP BY 1) c
LEFT JOIN (SELECT DISTINCT project FROM v) g USING (project)""")
def list_projects(spark, sf):
    """Projects by their vectors, with whether they have a graph."""
    counts = table(spark, sf, "code_vectors").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.countDistinct("vec_id").alias("node_count"))
    graphs = vertices_of(spark, sf).select("project").distinct().withColumn("g", F.lit(True))
    return counts.join(graphs, "project", "left").select("project", "node_count", F.col("g").isNotNull().alias("has_graph"))


def _ends(far, near, where):
    return f"WITH {H} SELECT DISTINCT project, {near}_name AS \"of\", {far}_name AS name, {far}_file AS file_path, {far}_kind AS kind FROM h WHERE {where}"


_CALLS = "type = 'CALLS' AND a_label = 'Function' AND b_label = 'Function'"
_USES = "type = 'USES' AND a_label = 'Function' AND b_label = 'Type'"


@query(_ends("a", "b", _CALLS))
def callers(spark, sf):
    """Callers of every function."""
    return graph_of(spark, sf).callers()


@query(_ends("b", "a", _CALLS))
def callees(spark, sf):
    """Functions that every function calls."""
    return graph_of(spark, sf).callees()


@query(_ends("b", "a", _USES))
def used_types(spark, sf):
    """Types that every function uses."""
    return graph_of(spark, sf).used_types()


@query(f"""WITH {H}
SELECT project, name AS "of", 'function' AS role, name, file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY file_path, start_line, kind, node_id) AS n FROM v) WHERE n = 1
UNION ALL SELECT DISTINCT project, b_name, 'caller', a_name, a_file FROM (SELECT DISTINCT project, b_name, a_name, a_file, a_kind FROM h WHERE {_CALLS})
UNION ALL SELECT DISTINCT project, a_name, 'callee', b_name, b_file FROM (SELECT DISTINCT project, a_name, b_name, b_file, b_kind FROM h WHERE {_CALLS})
UNION ALL SELECT DISTINCT project, a_name, 'used_type', b_name, b_file FROM (SELECT DISTINCT project, a_name, b_name, b_file, b_kind FROM h WHERE {_USES})""")
def function_context(spark, sf):
    """Own node, callers, callees and used types of every name."""
    return graph_of(spark, sf).context().distinct()


def _paths(depth):
    return f"""WITH RECURSIVE {H}, c AS (SELECT DISTINCT project, a_name, b_name FROM h WHERE {_CALLS} AND a_name <> b_name),
p AS (
  SELECT project, [a_name, b_name] AS path FROM c
  UNION ALL
  SELECT p.project, list_append(p.path, c.b_name) FROM p JOIN c ON c.project = p.project AND c.a_name = p.path[-1]
  WHERE len(p.path) <= {depth} AND NOT list_contains(p.path, c.b_name))
SELECT project, len(path) - 1 AS depth, path[-1] AS name, array_to_string(path, ' > ') AS path FROM p"""


@query(_paths(1))
def call_stack_d1(spark, sf):
    """Calls of every function."""
    return graph_of(spark, sf).call_paths(1)


@query(_paths(2))
def call_stack_d2(spark, sf):
    """Simple call paths of up to two calls from every function."""
    return graph_of(spark, sf).call_paths(2)


@query(_paths(3))
def call_stack_d3(spark, sf):
    """Simple call paths of up to three calls from every function."""
    return graph_of(spark, sf).call_paths(3)


@query(f"WITH {H} SELECT project, b_file AS file_path, a_file AS affected_file, a_name AS name, a_kind AS kind, type AS relationship FROM h WHERE a_file <> b_file")
def reverse_impact(spark, sf):
    """What depends on each file from other files, one row for each edge."""
    return graph_of(spark, sf).impact()


@query(f"""WITH {H} SELECT project, b_file AS file_path, a_file AS affected_file,
  array_to_string(list_sort(list_distinct(list(a_name || ' ' || type))), ', ') AS affected, count(*) AS edges FROM h WHERE a_file <> b_file GROUP BY ALL""")
def impact_by_file(spark, sf):
    """Affected files of each file, with the affected names."""
    return graph_of(spark, sf).impact_by_file()


@query(f"""WITH {V}, d AS (SELECT DISTINCT project, name FROM v WHERE kind = 'function' AND end_line > start_line)
SELECT project, file_path, node_id, name FROM v WHERE NOT (kind = 'function' AND start_line = end_line AND (project, name) IN (SELECT project, name FROM d))""")
def prototype_dedup(spark, sf):
    """Nodes without prototypes of functions defined elsewhere in the project."""
    return graph.without_prototypes(vertices_of(spark, sf)).select("project", "file_path", "node_id", "name")


@query(f"""WITH {E}, c AS (SELECT project, file_path FROM (
  SELECT coalesce(project, '') AS project, file_path, row_number() OVER (PARTITION BY project ORDER BY file_path) AS n FROM (SELECT DISTINCT project, file_path FROM nodes)) WHERE n = 1),
gone AS (SELECT v.node_id FROM v JOIN c USING (project, file_path))
SELECT project, type, count(*) AS edges FROM e WHERE src_id NOT IN (SELECT node_id FROM gone) AND dst_id NOT IN (SELECT node_id FROM gone) GROUP BY ALL""")
def clear_file_vertices(spark, sf):
    """Edges left by type when the first file of each project is cleared."""
    g = graph_of(spark, sf)
    first = g.v.groupBy("project").agg(F.min("file_path").alias("file_path"))
    gone = g.v.join(first, ["project", "file_path"], "left_semi").select("node_id")
    left = g.e.join(gone.withColumnRenamed("node_id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti")
    return left.groupBy("project", "type").agg(F.count("*").alias("edges"))


# -- what changed


_STATES = """now AS (SELECT DISTINCT project, file_path, sha256(content) AS hash FROM files WHERE content IS NOT NULL),
old AS (SELECT project, file_path, hash FROM (
  SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY last_indexed DESC NULLS LAST, hash DESC NULLS LAST) AS n FROM file_hashes) WHERE n = 1),
s AS (SELECT now.*, CASE WHEN now.hash IS NOT DISTINCT FROM old.hash THEN 'unchanged' ELSE 'changed' END AS state
  FROM now LEFT JOIN old USING (project, file_path))"""


def _states(spark, sf):
    return incremental.file_states(table(spark, sf, "files"), table(spark, sf, "file_hashes"))


@query(f"WITH {_STATES} SELECT project, file_path, hash FROM s WHERE state = 'changed'")
def changed_files(spark, sf):
    """Files that are new or whose content changed."""
    return _states(spark, sf).where("state = 'changed'").drop("state")


@query(f"WITH {_STATES} SELECT project, file_path, hash FROM s WHERE state = 'unchanged'")
def unchanged_files(spark, sf):
    """Files whose content is as recorded."""
    return _states(spark, sf).where("state = 'unchanged'").drop("state")


@query("""SELECT coalesce(project, '') AS project, file_path AS path, hash FROM (
  SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY last_indexed DESC NULLS LAST, hash DESC NULLS LAST) AS n FROM file_hashes WHERE file_path IS NOT NULL) WHERE n = 1""")
def file_vertices(spark, sf):
    """The vertex of each recorded file, with its path and hash."""
    return graph.file_vertices(table(spark, sf, "file_hashes"))


@query(f"""WITH {_STATES} SELECT project, file_path, hash FROM s
UNION ALL SELECT project, file_path, hash FROM old WHERE (project, file_path) NOT IN (SELECT project, file_path FROM now)""")
def upsert_file_hash(spark, sf):
    """Recorded hashes after the current files are indexed."""
    old = incremental.latest(table(spark, sf, "file_hashes"), ["project", "file_path"], "last_indexed").select("project", "file_path", "hash")
    return incremental.upsert(old, _states(spark, sf).drop("state"), ["project", "file_path"])


@query("""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, commit_hash ORDER BY loaded_at DESC NULLS LAST, date DESC NULLS LAST, author DESC NULLS LAST) AS n FROM git_commits) WHERE n = 1),
m AS (SELECT project, median(epoch(loaded_at)) AS t FROM c GROUP BY 1)
SELECT project, commit_hash FROM (SELECT c.project, commit_hash, row_number() OVER (PARTITION BY c.project ORDER BY date DESC NULLS LAST, commit_hash) AS k
  FROM c JOIN m USING (project) WHERE epoch(loaded_at) > t) WHERE k <= 500""")
def new_commits(spark, sf):
    """The newest 500 commits of each project that came after the median load."""
    c = incremental.latest(table(spark, sf, "git_commits").drop("embedding"), ["project", "commit_hash"], "loaded_at")
    at = F.unix_micros("loaded_at") / 1e6
    median = c.groupBy("project").agg(F.median(at).alias("t"))
    c = c.join(median, "project").withColumn("new", F.coalesce(at > F.col("t"), F.lit(False)))
    fresh = incremental.new_rows(c, c.where("not new"), ["project", "commit_hash"])
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("project").orderBy(F.col("date").desc_nulls_last(), "commit_hash"))
    return fresh.withColumn("k", k).where("k <= 500").select("project", "commit_hash")


@query("""WITH first AS (SELECT project, commit_hash, author, date FROM (SELECT *, row_number() OVER (PARTITION BY project, commit_hash ORDER BY loaded_at NULLS LAST, date NULLS LAST, author NULLS LAST) AS n FROM git_commits) WHERE n = 1),
last AS (SELECT project, commit_hash, message, diff_summary FROM (SELECT *, row_number() OVER (PARTITION BY project, commit_hash ORDER BY loaded_at DESC NULLS LAST, date DESC NULLS LAST, author DESC NULLS LAST, message DESC NULLS LAST) AS n FROM git_commits) WHERE n = 1)
SELECT project, commit_hash, author, date, message, md5(diff_summary) AS diff FROM first JOIN last USING (project, commit_hash)""")
def commit_upsert_keep_author(spark, sf):
    """Commits after every later load is merged into the first: author and date stay."""
    from pyspark.sql import Window

    c = table(spark, sf, "git_commits").select("project", "commit_hash", "author", "date", "message", "diff_summary", "loaded_at")
    up = Window.partitionBy("project", "commit_hash").orderBy(F.col("loaded_at").asc_nulls_last(), F.col("date").asc_nulls_last(), F.col("author").asc_nulls_last())
    down = Window.partitionBy("project", "commit_hash").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("date").desc_nulls_last(), F.col("author").desc_nulls_last(), F.col("message").desc_nulls_last())
    pick = lambda w: c.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "loaded_at")
    out = incremental.upsert_commits(pick(up), pick(down))
    return out.select("project", "commit_hash", "author", "date", "message", F.md5("diff_summary").alias("diff"))


@query("""SELECT project, count(DISTINCT vec_id) AS left_ FROM code_vectors WHERE project IS DISTINCT FROM (SELECT min(project) FROM code_vectors) GROUP BY ALL""")
def delete_project(spark, sf):
    """Vectors left by project when the first project is deleted."""
    v = table(spark, sf, "code_vectors")
    first = v.agg(F.min("project")).first()[0]
    return incremental.delete(v, project=first).groupBy("project").agg(F.countDistinct("vec_id").alias("left_"))


# -- texts


@query(f"""WITH {V} SELECT node_id, md5(name || chr(10) || signature || chr(10) || CASE WHEN length(body) > 1000 THEN substring(body, 1, 1000) || '...' ELSE body END) AS text FROM v""")
def embedding_text(spark, sf):
    """Digest of the text to embed of every node."""
    return vertices_of(spark, sf).select("node_id", F.md5(T.symbol_text(F.col("name"), F.col("signature"), F.col("body"))).alias("text"))


@query(r"""WITH c AS (SELECT DISTINCT project, commit_hash, coalesce(message, '') AS message, files_changed, coalesce(diff_summary, '') AS diff FROM git_commits),
n AS (SELECT *, CASE WHEN json_valid(files_changed) AND json_type(files_changed) = 'ARRAY' THEN array_to_string(from_json(files_changed, '["VARCHAR"]'), chr(10)) ELSE coalesce(files_changed, '') END AS names FROM c),
h AS (SELECT *, message || chr(10) || chr(10) || 'Files changed:' || chr(10) || names AS header FROM n)
SELECT project, commit_hash, md5(CASE WHEN length(header) >= 6000 THEN substring(header, 1, 6000) || '...'
  WHEN 5992 - length(header) <= 0 THEN header
  ELSE header || chr(10) || chr(10) || 'Diff:' || chr(10) || CASE WHEN length(diff) > 5992 - length(header) THEN substring(diff, 1, 5992 - length(header)) || '...' ELSE diff END END) AS text FROM h""")
def commit_text(spark, sf):
    """Digest of the text to embed of every commit."""
    c = table(spark, sf, "git_commits").select("project", "commit_hash", "message", "files_changed", "diff_summary")
    c = c.withColumns({"message": F.coalesce("message", F.lit("")), "diff_summary": F.coalesce("diff_summary", F.lit(""))}).distinct()
    return c.select("project", "commit_hash", F.md5(T.commit_text(F.col("message"), F.col("files_changed"), F.col("diff_summary"))).alias("text"))


@query(r"""SELECT project, name, count(*) AS n FROM (SELECT project, author AS name FROM git_commits) WHERE name IS NOT NULL GROUP BY ALL""".replace(
    "project, name, count(*) AS n", "regexp_replace(regexp_replace(regexp_replace(lower(project), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS project, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS name, count(*) AS n"))
def sanitize(spark, sf):
    """Project and author names as names of graphs."""
    c = table(spark, sf, "git_commits").where("author is not null")
    return c.groupBy(T.project_name(F.col("project")).alias("project"), T.project_name(F.col("author")).alias("name")).agg(F.count("*").alias("n"))


@query(rf"""SELECT project, file_path, count(*) AS lines, count(*) FILTER (regexp_matches({_strip('line')}, '{T.BOUNDARY}')) AS boundaries
FROM (SELECT project, file_path, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT project, file_path, content FROM files WHERE content IS NOT NULL)) GROUP BY ALL""")
def semantic_boundary(spark, sf):
    """Lines of every file and those that begin a part of it."""
    f = table(spark, sf, "files").where("content is not null").select("project", "file_path", "content").distinct()
    lines = f.select("project", "file_path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.groupBy("project", "file_path").agg(F.count("*").alias("lines"), F.count_if(T.is_boundary(F.col("line"))).alias("boundaries"))


@query("""SELECT DISTINCT project, commit_hash, strftime(date AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date FROM git_commits WHERE date IS NOT NULL""")
def iso_date(spark, sf):
    """Commit dates as text."""
    return table(spark, sf, "git_commits").where("date is not null").select("project", "commit_hash", T.iso_time(F.col("date")).alias("date")).distinct()


@query("""SELECT project, file, count(*) AS commits FROM (
  SELECT DISTINCT project, commit_hash, unnest(from_json(files_changed, '["VARCHAR"]')) AS file FROM git_commits
  WHERE json_valid(files_changed) AND json_type(files_changed) = 'ARRAY') GROUP BY ALL""")
def commits_by_file(spark, sf):
    """Number of commits that name each file."""
    c = table(spark, sf, "git_commits").select("project", "commit_hash", F.explode(T.changed_files(F.col("files_changed"))).alias("file")).distinct()
    return c.groupBy("project", "file").agg(F.count("*").alias("commits"))


@query("""SELECT project, file_path, 0 AS chunk_index, 1 AS total_chunks, md5(content) AS content, 1 AS start_line, len(string_split(content, chr(10))) AS end_line
FROM (SELECT DISTINCT project, file_path, content FROM files WHERE content IS NOT NULL AND length(content) <= 4800)""")
def chunk_small(spark, sf):
    """Files that fit in one chunk."""
    c = chunks.chunk_files(table(spark, sf, "files")).where("length(content) <= 4800 and total_chunks = 1")
    return c.withColumn("content", F.md5("content"))


@query()
def chunk_large(spark, sf):
    """Chunks of the files that need several."""
    return chunks.chunk_files(table(spark, sf, "files")).where("total_chunks > 1")


@query("""SELECT project, file_path, md5('File: ' || file_path || chr(10) || 'Chunk: 1 of 1' || chr(10) || 'Lines: 1-' || len(string_split(content, chr(10))) || chr(10) || '---' || chr(10) || content) AS text
FROM (SELECT DISTINCT project, file_path, content FROM files WHERE content IS NOT NULL AND length(content) <= 4800)""")
def chunk_text(spark, sf):
    """Digest of the text to embed of every single-chunk file."""
    c = chunks.chunk_files(table(spark, sf, "files")).where("length(content) <= 4800 and total_chunks = 1")
    text = T.chunk_text(F.col("file_path"), F.col("chunk_index"), F.col("total_chunks"), F.col("start_line"), F.col("end_line"), F.col("content"))
    return c.select("project", "file_path", F.md5(text).alias("text"))


# -- vectors

_VALID = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECTORS = f"x AS (SELECT DISTINCT vec_id, project, node_name, file_path, embedding::DOUBLE[] AS e FROM code_vectors WHERE {_VALID}), q AS (SELECT e AS q FROM x ORDER BY vec_id LIMIT 1)"


def _query_vector(spark, sf):
    from codeweft.functions.vectors import is_valid

    v = table(spark, sf, "code_vectors")
    return list(v.where(is_valid(F.col("embedding"), 64)).orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {_VECTORS} SELECT vec_id, project, node_name, round(list_cosine_similarity(e, q), 6) AS score FROM x, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    """The ten vectors most similar to the first."""
    hits = search.top_k(table(spark, sf, "code_vectors"), _query_vector(spark, sf))
    return hits.select("vec_id", "project", "node_name", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTORS} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM x, q WHERE project = 'harbor-grid' ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_topk_scoped(spark, sf):
    """The same within one project."""
    hits = search.top_k(table(spark, sf, "code_vectors"), _query_vector(spark, sf), project="harbor-grid")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTORS} SELECT project, vec_id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY s DESC, vec_id) AS n FROM (SELECT project, vec_id, list_cosine_similarity(e, q) AS s FROM x, q)) WHERE n <= 3""")
def vector_topk_per_project(spark, sf):
    """The three vectors of each project most similar to the first."""
    from pyspark.sql import Window

    from codeweft.functions.vectors import cosine, is_valid

    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    v = table(spark, sf, "code_vectors").where(is_valid(F.col("embedding"), 64)).dropDuplicates(["vec_id"]).select("project", "vec_id", cosine(F.col("embedding"), q).alias("s"))
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("s"), "vec_id"))
    return v.withColumn("n", n).where("n <= 3").select("project", "vec_id", F.round("s", 6).alias("score"))


@query(f"""WITH {_VECTORS} SELECT "query", key, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY s DESC, key) AS rank FROM (
    SELECT a.vec_id AS "query", b.vec_id AS key, list_cosine_similarity(a.e, b.e) AS s FROM x a, x b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5""")
def vector_search_each(spark, sf):
    """The five vectors most similar to each query vector (ids divisible by 100)."""
    v = table(spark, sf, "code_vectors")
    return search.top_k_each(v, v.where("vec_id % 100 = 0"), k=5).select("query", "key", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTORS}, {V}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, name, file_path ORDER BY start_line, kind, node_id) AS n FROM v) WHERE n = 1),
t AS (SELECT vec_id, project, node_name, file_path, list_cosine_similarity(e, q) AS s FROM x, q ORDER BY s DESC, vec_id LIMIT 50)
SELECT vec_id, t.project, node_name, t.file_path, f.kind, f.signature, f.start_line || '-' || f.end_line AS lines, printf('%.4f', s) AS score
FROM t LEFT JOIN f ON f.project = t.project AND f.name = t.node_name AND f.file_path = t.file_path""")
def search_enriched(spark, sf):
    """Fifty search hits with kind, signature and lines of their node."""
    hits = search.top_k(table(spark, sf, "code_vectors"), _query_vector(spark, sf), k=50)
    out = search.enriched(hits.select("vec_id", "project", "node_name", "file_path", "score"), vertices_of(spark, sf))
    return out.withColumn("score", T.score_text(F.col("score")))


@query(f"""WITH x AS (SELECT DISTINCT commit_hash, project, message, files_changed, embedding::DOUBLE[] AS e FROM git_commits WHERE {_VALID}),
q AS (SELECT e AS q FROM x ORDER BY commit_hash LIMIT 1)
SELECT commit_hash, message, coalesce(len(CASE WHEN json_valid(files_changed) AND json_type(files_changed) = 'ARRAY' THEN from_json(files_changed, '["VARCHAR"]') END), 0) AS files, round(list_cosine_similarity(e, q), 6) AS score
FROM x, q ORDER BY list_cosine_similarity(e, q) DESC, commit_hash LIMIT 10""")
def commit_search(spark, sf):
    """The ten commits most similar to the first, with their number of files."""
    from codeweft.functions.vectors import is_valid

    c = table(spark, sf, "git_commits").select("commit_hash", "project", "message", "files_changed", "embedding")
    q = list(c.where(is_valid(F.col("embedding"), 64)).orderBy("commit_hash").select("embedding").first()[0])
    hits = search.top_k(c, q, key="commit_hash")
    files = F.coalesce(F.array_size(T.changed_files(F.col("files_changed"))), F.lit(0))
    return hits.select("commit_hash", "message", files.alias("files"), F.round("score", 6).alias("score"))
