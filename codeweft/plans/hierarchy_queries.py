"""Problem 1: hierarchies of types."""

from codeweft.operators import hierarchy as H
from codeweft.plans.tables import table


def p1_found(spark, sf):
    """(project, ancestor, descendant) over EXTENDS and IMPLEMENTS rows."""
    return H.reachable(H.parent_links(table(spark, sf, "raw_relationships")))


def p1_hierarchy(spark, sf):
    """Path, depth, root, number of descendants and cycle flags of each name."""
    return H.hierarchy(H.parent_links(table(spark, sf, "raw_relationships")))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy}

LINKS = r"""links AS (
  SELECT DISTINCT project, child, parent FROM (
    SELECT coalesce(project, '') AS project, regexp_replace(source_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS child,
      regexp_replace(target_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS parent
    FROM raw_relationships
    WHERE upper(regexp_replace(relationship_kind, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) IN ('EXTENDS', 'IMPLEMENTS'))
  WHERE child <> '' AND parent <> '')"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {LINKS},
pairs AS (
  SELECT project, parent AS ancestor, child AS descendant FROM links
  UNION
  SELECT p.project, l.parent, p.descendant FROM pairs p JOIN links l ON l.project = p.project AND l.child = p.ancestor)
SELECT project, ancestor, descendant FROM pairs""",
    "p1_hierarchy": f"""WITH RECURSIVE {LINKS},
pairs AS (
  SELECT project, parent AS ancestor, child AS descendant FROM links
  UNION
  SELECT p.project, l.parent, p.descendant FROM pairs p JOIN links l ON l.project = p.project AND l.child = p.ancestor),
below AS (
  SELECT project, ancestor AS name, count(*) AS descendants, bool_or(ancestor = descendant) AS on_cycle
  FROM pairs GROUP BY ALL),
firsts AS (SELECT project, child, min(parent) AS parent FROM links GROUP BY ALL),
roots AS (
  SELECT DISTINCT project, parent AS name FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM links c WHERE c.project = l.project AND c.child = l.parent)),
down AS (
  SELECT project, name, name AS path, 0 AS depth, name AS root FROM roots
  UNION ALL
  SELECT d.project, f.child, d.path || ' > ' || f.child, d.depth + 1, d.root
  FROM down d JOIN firsts f ON f.project = d.project AND f.parent = d.name),
names AS (SELECT project, child AS name FROM firsts UNION SELECT project, name FROM roots)
SELECT n.project, n.name, d.path, d.depth, d.root, d.name IS NULL AS cyclic,
  coalesce(b.descendants, 0) AS descendants, coalesce(b.on_cycle, false) AS on_cycle
FROM names n LEFT JOIN down d USING (project, name) LEFT JOIN below b USING (project, name)""",
}
