"""The documented graph patterns as DataFrame plans, with their SQL.

Every pattern runs over all projects at once.  A limit is kept only where the
pattern has one; its order is then made total.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeweft.plans.core_queries import E, H, V, graph_of, vertices_of

QUERIES, SQL = {}, {}


def pattern(sql):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _labelled(label):
    def run(spark, sf):
        return vertices_of(spark, sf).where(F.col("label") == label).select("project", "name", "file_path", "signature")

    return run


def _labelled_sql(label):
    return f"WITH {V} SELECT project, name, file_path, signature FROM v WHERE label = '{label}'"


for _name, _label in (("cypher_c03", "Class"), ("cypher_c04", "Type"), ("cypher_c17", "Contract"), ("cypher_c20", "Trait")):
    QUERIES[_name], SQL[_name] = _labelled(_label), _labelled_sql(_label)


@pattern(f"WITH {V} SELECT project, name, file_path FROM v WHERE label = 'Function' ORDER BY project, name, file_path, node_id LIMIT 25")
def cypher_c01(spark, sf):
    """Functions, the first 25."""
    return vertices_of(spark, sf).where("label = 'Function'").orderBy("project", "name", "file_path", "node_id").limit(25).select("project", "name", "file_path")


@pattern(f"WITH {V} SELECT project, name, file_path, signature FROM v WHERE label = 'Function' AND name = (SELECT min(name) FROM v WHERE label = 'Function')")
def cypher_c02(spark, sf):
    """The functions of one name."""
    f = vertices_of(spark, sf).where("label = 'Function'")
    return f.join(f.agg(F.min("name").alias("name")), "name", "left_semi").select("project", "name", "file_path", "signature")


def _hop(name, sql_where, doc, **kw):
    columns = "project, a_name, a_file, b_name, b_file"

    def run(spark, sf):
        return graph_of(spark, sf).hop(**kw).select("project", "a_name", F.col("a_file_path").alias("a_file"), "b_name", F.col("b_file_path").alias("b_file"))

    run.__doc__ = doc
    QUERIES[name], SQL[name] = run, f"WITH {H} SELECT {columns} FROM h WHERE {sql_where}"


_hop("cypher_c05", "type = 'CALLS' AND b_label = 'Function'", "Callers of functions.", types=["CALLS"], b_label="Function")
_hop("cypher_c06", "type = 'CALLS' AND a_label = 'Function'", "Callees of functions.", types=["CALLS"], a_label="Function")
_hop("cypher_c09", "type = 'USES' AND a_label = 'Function' AND b_label = 'Type'", "Types that functions use.", types=["USES"], a_label="Function", b_label="Type")
_hop("cypher_c10", "type = 'USES' AND b_label = 'Type'", "Users of types.", types=["USES"], b_label="Type")
_hop("cypher_c11", "type = 'EXTENDS' AND a_label = 'Class' AND b_label = 'Class'", "Subclasses.", types=["EXTENDS"], a_label="Class", b_label="Class")
_hop("cypher_c12", "type = 'IMPLEMENTS' AND b_label = 'Type'", "Implementations of interfaces.", types=["IMPLEMENTS"], b_label="Type")
_hop("cypher_c19", "type = 'EXTENDS' AND a_label = 'Contract'", "What contracts inherit from.", types=["EXTENDS"], a_label="Contract")
_hop("cypher_c21", "type = 'IMPLEMENTS' AND b_label = 'Trait'", "Implementations of traits.", types=["IMPLEMENTS"], b_label="Trait")


@pattern(f"""WITH {H} SELECT x.project, x.a_name, x.b_name, y.b_name AS c_name FROM h x JOIN h y
ON y.src_id = x.dst_id AND y.project = x.project AND x.type = 'CALLS' AND y.type = 'CALLS' AND NOT (x.src_id = y.src_id AND x.dst_id = y.dst_id)""")
def cypher_c07(spark, sf):
    """Chains of two calls; the two edges differ."""
    g = graph_of(spark, sf)
    x = g.hop("a", "b", ["CALLS"]).select("project", "a_id", "b_id", "a_name", "b_name")
    y = g.hop("b", "c", ["CALLS"]).select("project", "b_id", "c_id", "c_name")
    return x.join(y, ["project", "b_id"]).where("not (a_id = b_id and b_id = c_id)").select("project", "a_name", "b_name", "c_name")


@pattern(f"WITH {H} SELECT project, b_name AS name, count(*) AS calls FROM h WHERE type = 'CALLS' AND b_label = 'Function' GROUP BY ALL ORDER BY calls DESC, project, name LIMIT 20")
def cypher_c08(spark, sf):
    """The most called functions."""
    h = graph_of(spark, sf).hop(types=["CALLS"], b_label="Function")
    return h.groupBy("project", F.col("b_name").alias("name")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "project", "name").limit(20)


@pattern(f"WITH {V} SELECT project, file_path, string_agg(name, ' ' ORDER BY start_line, name, node_id) AS names FROM v GROUP BY ALL")
def cypher_c13(spark, sf):
    """The nodes of every file, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "name", "node_id")))
    return vertices_of(spark, sf).groupBy("project", "file_path").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " ").alias("names"))


@pattern(f"WITH {H} SELECT project, a_file, b_file, count(*) AS n FROM h WHERE type = 'CALLS' AND a_file <> b_file GROUP BY ALL")
def cypher_c14(spark, sf):
    """Calls between files."""
    h = graph_of(spark, sf).hop(types=["CALLS"]).where("a_file_path <> b_file_path")
    return h.groupBy("project", F.col("a_file_path").alias("a_file"), F.col("b_file_path").alias("b_file")).agg(F.count("*").alias("n"))


@pattern(f"WITH {H} SELECT DISTINCT project, a_file, type, b_name, b_file FROM h WHERE a_file <> b_file")
def cypher_c15(spark, sf):
    """What files depend on elsewhere, by any edge."""
    rows = graph_of(spark, sf).hop().where("a_file_path <> b_file_path")
    return rows.select("project", F.col("a_file_path").alias("a_file"), "type", "b_name", F.col("b_file_path").alias("b_file")).distinct()


@pattern(f"WITH {H} SELECT project, name, file_path FROM v WHERE label = 'Function' AND name <> 'main' AND node_id NOT IN (SELECT dst_id FROM h WHERE type = 'CALLS')")
def cypher_c16(spark, sf):
    """Functions that nothing calls."""
    g = graph_of(spark, sf)
    called = g.e.where("type = 'CALLS'").select(F.col("dst_id").alias("node_id"))
    return g.v.where("label = 'Function' and name <> 'main'").join(called, "node_id", "left_anti").select("project", "name", "file_path")


@pattern(f"WITH {V} SELECT project, name, file_path FROM v WHERE label = 'Event' AND regexp_matches(name, '(^|[.])[A-M]')")
def cypher_c18(spark, sf):
    """Events whose own name begins with A to M."""
    return vertices_of(spark, sf).where((F.col("label") == "Event") & F.col("name").rlike("(^|[.])[A-M]")).select("project", "name", "file_path")


@pattern(f"WITH {V} SELECT project, name, file_path FROM v WHERE label = 'Impl' AND name LIKE 'impl %'")
def cypher_c22(spark, sf):
    """Implementation blocks by the beginning of their name."""
    return vertices_of(spark, sf).where((F.col("label") == "Impl") & F.col("name").startswith("impl ")).select("project", "name", "file_path")


@pattern(f"WITH {V} SELECT kind, count(*) AS n FROM v GROUP BY ALL")
def cypher_c23(spark, sf):
    """Nodes by kind."""
    return vertices_of(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@pattern(f"WITH {V} SELECT project, file_path, count(*) AS n FROM v WHERE label = 'Function' GROUP BY ALL ORDER BY n DESC, project, file_path LIMIT 20")
def cypher_c24(spark, sf):
    """The files with the most functions."""
    v = vertices_of(spark, sf).where("label = 'Function'")
    return v.groupBy("project", "file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project", "file_path").limit(20)


@pattern(f"""WITH {E}, o AS (SELECT src_id AS node_id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst_id AS node_id, count(*) AS n FROM e GROUP BY 1)
SELECT project, name, sum(coalesce(o.n, 0))::BIGINT AS outgoing, sum(coalesce(i.n, 0))::BIGINT AS incoming FROM v LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)
WHERE label = 'Function' GROUP BY ALL ORDER BY outgoing + incoming DESC, project, name LIMIT 20""")
def cypher_c25(spark, sf):
    """The most connected functions; edges are counted by vertex before they meet."""
    g = graph_of(spark, sf)
    out = g.e.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("o"))
    in_ = g.e.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("i"))
    rows = g.v.where("label = 'Function'").join(out, "node_id", "left").join(in_, "node_id", "left")
    sums = rows.groupBy("project", "name").agg(F.sum(F.coalesce("o", F.lit(0))).alias("outgoing"), F.sum(F.coalesce("i", F.lit(0))).alias("incoming"))
    return sums.orderBy(F.desc(F.col("outgoing") + F.col("incoming")), "project", "name").limit(20)


_TRAILS = f"""WITH RECURSIVE {E}, c AS (SELECT src_id, dst_id, src_id || '>' || dst_id AS k FROM e WHERE type = 'CALLS'),
t AS (
  SELECT src_id, dst_id, [k] AS ks, [src_id, dst_id] AS ids FROM c
  UNION ALL
  SELECT t.src_id, c.dst_id, list_append(t.ks, c.k), list_append(t.ids, c.dst_id) FROM t JOIN c ON c.src_id = t.dst_id WHERE len(t.ks) < 3 AND NOT list_contains(t.ks, c.k))"""


def _trails(spark, sf, longest=3):
    """Paths of one to ``longest`` calls that use no edge twice: (src_id, dst_id, ids)."""
    calls = graph_of(spark, sf).e.where("type = 'CALLS'").select("src_id", "dst_id", F.concat_ws(">", "src_id", "dst_id").alias("k"))
    level = calls.select("src_id", "dst_id", F.array("k").alias("ks"), F.array("src_id", "dst_id").alias("ids"))
    out, step = level, calls.withColumnsRenamed({"src_id": "at", "dst_id": "next"})
    for _ in range(longest - 1):
        level = level.join(step, F.col("dst_id") == F.col("at")).where(~F.array_contains("ks", F.col("k"))).select(
            "src_id", F.col("next").alias("dst_id"), F.concat("ks", F.array("k")).alias("ks"), F.concat("ids", F.array("next")).alias("ids")
        )
        out = out.unionByName(level)
    return out


@pattern(_TRAILS + " SELECT src_id, dst_id, len(ks) AS length FROM t")
def cypher_c26(spark, sf):
    """Callees within three calls, with the length of each path."""
    return _trails(spark, sf).select("src_id", "dst_id", F.size("ks").alias("length"))


@pattern(_TRAILS + " SELECT id, count(*) AS paths FROM (SELECT unnest(ids) AS id FROM t) GROUP BY ALL")
def cypher_c27(spark, sf):
    """How many of these paths lead over each node."""
    return _trails(spark, sf).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("paths"))


@pattern(_TRAILS + " SELECT DISTINCT src_id, dst_id FROM t")
def cypher_c28(spark, sf):
    """Distinct pairs of functions within three calls."""
    return _trails(spark, sf).select("src_id", "dst_id").distinct()


@pattern(f"WITH {V} SELECT a.project, a.name, a.file_path AS a_file, b.file_path AS b_file FROM v a, v b WHERE a.project = b.project AND a.name = b.name AND a.label = b.label AND a.label = 'Function' AND a.file_path < b.file_path")
def cypher_c29(spark, sf):
    """Two nodes in one pattern without an edge: functions of one name in two files."""
    f = vertices_of(spark, sf).where("label = 'Function'").select("project", "name", "file_path")
    a, b = f.withColumnRenamed("file_path", "a_file"), f.withColumnRenamed("file_path", "b_file")
    return a.join(b, ["project", "name"]).where("a_file < b_file")


@pattern(f"""WITH {H} SELECT project, file_path, count(*) AS edges FROM (
  SELECT project, a_file AS file_path FROM h UNION ALL SELECT project, b_file FROM h WHERE src_id <> dst_id) GROUP BY ALL""")
def cypher_c30(spark, sf):
    """Edges that touch each file, from either end."""
    g = graph_of(spark, sf)
    ends = g.undirected().select("project", F.col("src_id").alias("node_id"))
    return ends.join(g.v.select("node_id", "file_path"), "node_id").groupBy("project", "file_path").agg(F.count("*").alias("edges"))


@pattern(f"""WITH {V} SELECT project, name, file_path, 'function' AS what FROM v WHERE label = 'Function' AND contains(lower(name), 'token')
UNION ALL SELECT project, name, file_path, 'class' FROM v WHERE label = 'Class' AND ends_with(name, 'Store')""")
def cypher_union(spark, sf):
    """UNION ALL of two patterns with string predicates."""
    v = vertices_of(spark, sf)
    pick = lambda where, what: v.where(where).select("project", "name", "file_path", F.lit(what).alias("what"))
    return pick((F.col("label") == "Function") & F.lower("name").contains("token"), "function").unionByName(
        pick((F.col("label") == "Class") & F.col("name").endswith("Store"), "class")
    )


@pattern(f"""WITH {V} SELECT project, label, count(*) AS n, avg(end_line - start_line + 1) AS mean, min(start_line) AS first, max(end_line) AS last,
  stddev_samp(end_line - start_line + 1) AS deviation, quantile_cont(end_line - start_line + 1, 0.5) AS median, count(DISTINCT file_path) AS files FROM v GROUP BY ALL""")
def cypher_aggregates(spark, sf):
    """The aggregates of the pattern language by project and label."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return vertices_of(spark, sf).groupBy("project", "label").agg(
        F.count("*").alias("n"), F.avg(lines).alias("mean"), F.min("start_line").alias("first"), F.max("end_line").alias("last"),
        F.stddev_samp(lines).alias("deviation"), F.percentile(lines, F.lit(0.5)).alias("median"), F.countDistinct("file_path").alias("files"),
    )


@pattern(f"""WITH {H} SELECT project, name, CASE WHEN calls >= 3 THEN 'hot' WHEN calls > 0 THEN 'used' ELSE 'unused' END AS state FROM (
  SELECT v.project, v.name, count(h.src_id) AS calls FROM v LEFT JOIN h ON h.dst_id = v.node_id AND h.type = 'CALLS' WHERE v.label = 'Function' GROUP BY v.project, v.name)""")
def cypher_case(spark, sf):
    """OPTIONAL MATCH, WITH an aggregate, and CASE on it."""
    g = graph_of(spark, sf)
    calls = g.e.where("type = 'CALLS'").groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("c"))
    sums = g.v.where("label = 'Function'").join(calls, "node_id", "left").groupBy("project", "name").agg(F.sum(F.coalesce("c", F.lit(0))).alias("calls"))
    state = F.when(F.col("calls") >= 3, "hot").when(F.col("calls") > 0, "used").otherwise("unused")
    return sums.select("project", "name", state.alias("state"))


@pattern(f"""WITH {V} SELECT project, name, signature FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY end_line - start_line DESC, name, node_id) AS n FROM v WHERE label = 'Function') WHERE n BETWEEN 3 AND 5""")
def cypher_skip_limit(spark, sf):
    """SKIP 2 LIMIT 3 within each project: the third to fifth longest function."""
    w = Window.partitionBy("project").orderBy((F.col("end_line") - F.col("start_line")).desc(), "name", "node_id")
    v = vertices_of(spark, sf).where("label = 'Function'").withColumn("n", F.row_number().over(w))
    return v.where("n between 3 and 5").select("project", "name", "signature")
