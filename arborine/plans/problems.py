"""Queries and reference SQL of the general data problems (1, 5 and 6)."""

from __future__ import annotations

from arborine.operators.hierarchy import ancestors, full_paths, hierarchy, links
from arborine.operators.orphans import orphan_references, orphan_report
from arborine.operators.skew import dependents, refreshed_hubs
from arborine.sources.tables import table


def _edges(spark, d):
    return table(spark, d, "edges")


def p1_found(spark, d):
    return hierarchy(links(_edges(spark, d)))


def p1_ancestors(spark, d):
    return ancestors(links(_edges(spark, d)))


def p1_paths(spark, d):
    return full_paths(links(_edges(spark, d)))


def _orphans(spark, d):
    return orphan_references(_edges(spark, d), table(spark, d, "symbols"), table(spark, d, "file_changes"))


def p5_found(spark, d):
    return _orphans(spark, d).select("edge_id", "reason")


def p5_report(spark, d):
    return orphan_report(_edges(spark, d), _orphans(spark, d))


def p6_found(spark, d):
    return dependents(_edges(spark, d), share=0.01)


def p6_dependents(spark, d):
    return dependents(_edges(spark, d))


def p6_hub_files(spark, d):
    return refreshed_hubs(_edges(spark, d), table(spark, d, "hub_files"), table(spark, d, "symbols"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ancestors, p1_paths, p5_found, p5_report, p6_found, p6_dependents, p6_hub_files)}

_LINKS = """
links AS (
  SELECT kind, child, min(parent) AS parent FROM (
    SELECT kind, CASE WHEN kind = 'defines' THEN dst_id ELSE src_id END AS child,
           CASE WHEN kind = 'defines' THEN src_id ELSE dst_id END AS parent
    FROM edges WHERE kind IN ('defines', 'inherits') AND contains(dst_id, '/') AND src_id IS NOT NULL)
  GROUP BY kind, child),
up AS (
  SELECT kind, child AS node, parent AS anc FROM links
  UNION
  SELECT up.kind, up.node, links.parent FROM up JOIN links ON links.kind = up.kind AND links.child = up.anc),
onring AS (SELECT DISTINCT kind, node FROM up WHERE node = anc),
tops AS (SELECT DISTINCT kind, parent AS id FROM links EXCEPT SELECT kind, child FROM links),
deep AS (SELECT kind, node, count(*) AS d FROM up GROUP BY kind, node),
ends AS (SELECT up.kind, up.node, up.anc AS root, deep.d FROM up JOIN tops t ON t.kind = up.kind AND t.id = up.anc JOIN deep ON deep.kind = up.kind AND deep.node = up.node)
"""
_ORPHANS = """
good AS (SELECT id, min(path) AS path, min(indexed_at) AS born FROM symbols WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id),
gone AS (SELECT path FROM (SELECT path, arg_max(removed, seq) AS removed FROM file_changes WHERE path IS NOT NULL AND seq IS NOT NULL GROUP BY path) WHERE removed),
orphans AS (
  SELECT * FROM (
    SELECT e.edge_id, e.kind, e.indexed_at,
      CASE WHEN g.id IS NULL THEN 'missing' WHEN x.path IS NOT NULL THEN 'deleted' WHEN g.born > e.indexed_at THEN 'late' END AS reason
    FROM edges e LEFT JOIN good g ON g.id = e.dst_id LEFT JOIN gone x ON x.path = g.path
    WHERE contains(e.dst_id, '/'))
  WHERE reason IS NOT NULL)
"""

ORACLE = {
    "p1_found": f"""
WITH RECURSIVE {_LINKS},
rings AS (SELECT up.kind, up.node, min(up.anc) AS root FROM up JOIN onring r ON r.kind = up.kind AND r.node = up.anc GROUP BY up.kind, up.node)
SELECT kind, id AS node_id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM tops
UNION ALL
SELECT kind, node, root, CAST(d AS BIGINT) FROM ends
UNION ALL
SELECT kind, node, root, CAST(-1 AS BIGINT) FROM rings
""",
    "p1_ancestors": f"""
WITH RECURSIVE {_LINKS}
SELECT up.kind, up.anc AS ancestor_id, up.node AS node_id, CAST(e.d - coalesce(a.d, 0) AS BIGINT) AS distance
FROM up JOIN ends e ON e.kind = up.kind AND e.node = up.node LEFT JOIN deep a ON a.kind = up.kind AND a.node = up.anc
""",
    "p1_paths": f"""
WITH RECURSIVE {_LINKS}
SELECT kind, id AS node_id, CAST(0 AS BIGINT) AS depth, id AS path FROM tops
UNION ALL
SELECT up.kind, up.node, CAST(max(e.d) AS BIGINT), string_agg(up.anc, ' > ' ORDER BY coalesce(a.d, 0)) || ' > ' || up.node
FROM up JOIN ends e ON e.kind = up.kind AND e.node = up.node LEFT JOIN deep a ON a.kind = up.kind AND a.node = up.anc GROUP BY up.kind, up.node
UNION ALL
SELECT l.kind, l.child, CAST(-1 AS BIGINT), NULL FROM links l ANTI JOIN ends e ON e.kind = l.kind AND e.node = l.child
""",
    "p5_found": f"WITH {_ORPHANS} SELECT edge_id, reason FROM orphans",
    "p5_report": f"""
WITH {_ORPHANS},
refs AS (SELECT kind, strftime(indexed_at, '%Y-%m') AS period, count(*) AS refs FROM edges WHERE contains(dst_id, '/') GROUP BY ALL),
found AS (SELECT kind, strftime(indexed_at, '%Y-%m') AS period, reason, count(*) AS orphans FROM orphans GROUP BY ALL)
SELECT f.kind, f.period, f.reason, f.orphans, r.refs FROM found f JOIN refs r ON f.kind IS NOT DISTINCT FROM r.kind AND f.period IS NOT DISTINCT FROM r.period
""",
    "p6_found": "SELECT dst_id, count(DISTINCT src_id) AS dependents FROM edges WHERE dst_id IS NOT NULL GROUP BY dst_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p6_dependents": "SELECT dst_id, count(DISTINCT src_id) AS dependents FROM edges WHERE dst_id IS NOT NULL GROUP BY dst_id",
    "p6_hub_files": """
SELECT h.path, coalesce(c.n, 0) AS dependents, coalesce(h.recorded, -1) AS recorded, f.id IS NOT NULL AS is_file
FROM (SELECT path, max(dependents) AS recorded FROM hub_files WHERE path IS NOT NULL GROUP BY path) h
LEFT JOIN (SELECT dst_id, count(DISTINCT src_id) AS n FROM edges GROUP BY dst_id) c ON c.dst_id = h.path
LEFT JOIN (SELECT DISTINCT id FROM symbols WHERE kind = 'file') f ON f.id = h.path
""",
}
