"""The registered queries on training data."""

from pyspark.sql import functions as F

from codeweft.llm import encoding, leaks, mixing, near_dups, neighbours, parsing, provenance, secrets
from codeweft.plans.tables import table


def p2_found(spark, sf):
    """(project, file_path) of generated, minified, third-party and data files."""
    return provenance.provenance(table(spark, sf, "files")).where("kind is not null").select("project", "file_path")


def p2_measures(spark, sf):
    """Kind and measures of every file."""
    return provenance.provenance(table(spark, sf, "files"))


def p3_found(spark, sf):
    """(project, file_path) of each file that its language's parser rejects."""
    return parsing.syntax(table(spark, sf, "files")).where("cost > 0").select("project", "file_path")


def p3_rates(spark, sf):
    """Files, invalid files, their rate and edits by project and language."""
    return parsing.rates(table(spark, sf, "files"))


def _neighbours(spark, sf, name, key):
    df = table(spark, sf, name)
    return neighbours.neighbours(neighbours.valid_vectors(df, F.col(key).cast("string"), F.col("embedding"), 64))


def p4_found(spark, sf):
    """Pairs of which one is among the five most similar of the other, for both tables."""
    tables = [("code_vectors", "vec_id"), ("git_commits", "commit_hash")]
    parts = [neighbours.pairs(_neighbours(spark, sf, *t)).select(F.lit(t[0]).alias("source_table"), "key_a", "key_b") for t in tables]
    return parts[0].unionByName(parts[1])


def p4_neighbours(spark, sf):
    """The five most similar of every code vector, with their similarity."""
    return _neighbours(spark, sf, "code_vectors", "vec_id")


def _credentials(spark, sf):
    return secrets.credentials(secrets.code_records(*(table(spark, sf, t) for t in ("nodes", "git_commits", "files"))))


def p5_found(spark, sf):
    """(source_table, project, record_key) of each record with a credential."""
    return _credentials(spark, sf).select("source_table", "project", "record_key")


def p5_redacted(spark, sf):
    """Each such record with the kinds found and its text without the credentials."""
    return _credentials(spark, sf)


def _near_nodes(spark, sf, threshold=0.7):
    return near_dups.near_duplicates(near_dups.node_records(table(spark, sf, "nodes")), threshold=threshold, least=30)


def p6_found(spark, sf):
    """(node_id_a, node_id_b) of similarity >= 0.7, copies included."""
    members, links = _near_nodes(spark, sf)
    a = members.select(F.col("id").alias("a"), F.col("class_id").alias("class_a"))
    b = members.select(F.col("id").alias("b"), F.col("class_id").alias("class_b"))
    copies = near_dups.copy_pairs(members)
    others = links.join(a, "class_a").join(b, "class_b").select("a", "b")
    return copies.unionByName(others).select(
        F.least("a", "b").alias("node_id_a"), F.greatest("a", "b").alias("node_id_b")
    )


def p6_classes(spark, sf):
    """Each node with enough tokens, its class of equal sets and the class's links (similarity >= 0.7)."""
    members, links = _near_nodes(spark, sf)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(counts, "class_id", "left").select(
        F.col("id").alias("node_id"), "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")
    )


def p7_found(spark, sf):
    """(doc_id, item_id) of exact passages: 12 shared words, or all of a shorter item."""
    found = leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.where("run >= needed").select("doc_id", "item_id")


def p7_near(spark, sf):
    """Leaks found exactly or with one word edit, with run and distance."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_items(spark, sf):
    """Each leaked item with the number of documents it leaked into."""
    found = leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("run") >= F.col("needed")).alias("exact"))


def p8_schedule(spark, sf):
    """The mixture: document pieces of each slot."""
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark, sf):
    """Target and actual share of each source."""
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_found(spark, sf):
    """doc_id of each document with a stretch decoded with a wrong encoding."""
    return encoding.garbled(table(spark, sf, "documents")).select("doc_id")


def p9_repaired(spark, sf):
    """Chain, posterior and restored text of each garbled document."""
    return encoding.repaired(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_measures, p3_found, p3_rates, p4_found, p4_neighbours, p5_found, p5_redacted, p6_found, p6_classes, p7_found, p7_near, p7_items, p8_schedule, p8_shares, p9_found, p9_repaired)}

SQL = {
    "p6_found": r"""WITH n AS (
  SELECT node_id, any_value(coalesce(kind, '')) AS kind, any_value(coalesce(signature, '') || chr(10) || coalesce(body, '')) AS t
  FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id),
w AS (SELECT node_id, kind, regexp_extract_all(t, '[A-Za-z0-9_]+') AS w FROM n),
s AS (
  SELECT DISTINCT node_id, kind, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT node_id, kind, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT node_id, kind, count(*) AS k FROM s GROUP BY ALL HAVING count(*) >= 30),
common AS (
  SELECT a.node_id AS node_id_a, b.node_id AS node_id_b, count(*) AS n
  FROM s a JOIN s b ON a.g = b.g AND a.kind = b.kind AND a.node_id < b.node_id GROUP BY ALL)
SELECT node_id_a, node_id_b FROM common JOIN c a ON a.node_id = node_id_a JOIN c b ON b.node_id = node_id_b
WHERE n >= 0.7 * (a.k + b.k - n)""",
    # Every run of 12 words of an item, and every whole item that is shorter, looked up among the runs of the documents.
    "p7_found": r"""WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
i AS (SELECT item_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL GROUP BY item_id),
runs AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS run FROM (
    SELECT item_id, w, least(12, len(w)) AS n, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
texts AS (
  SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS run FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM runs) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM texts JOIN runs USING (n, run)""",
}


def llm_queries():
    return dict(QUERIES)


def llm_sql():
    return dict(SQL)
