"""Queries and reference SQL of the code-graph operators, over the symbol, edge and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborine.api import CodeGraph
from arborine.functions import text as T
from arborine.functions.embedding import native_places, null_embedder
from arborine.functions.languages import EXTENSIONS, IGNORED_DIRS, language_for
from arborine.operators import lookup as L
from arborine.operators import metrics as M
from arborine.operators import resolve as R
from arborine.operators import retrieve as V
from arborine.operators import snapshot as S
from arborine.operators import traverse as X
from arborine.operators.skew import ranked
from arborine.operators.vectors import VectorTable
from arborine.sources.extract import extracted_edges, extracted_symbols, parse_files
from arborine.sources.scratch import Scratch
from arborine.sources.tables import table
from arborine.streaming.changes import ChangeState, change_stream, run_available

QUERIES: dict = {}
ORACLE: dict = {}
BUDGET = 200


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def nodes(spark, d) -> DataFrame:
    return S.upsert_nodes(table(spark, d, "symbols"))


def edges(spark, d) -> DataFrame:
    return S.upsert_edges(table(spark, d, "edges"), nodes(spark, d))


_REST = "kind, name, qualified_name, path, language, signature, docstring, start_line, end_line"
_BASE = f"""
sym AS (
  SELECT id, coalesce(kind, '') AS kind, coalesce(name, '') AS name, coalesce(qualified_name, '') AS qualified_name, path, coalesce(language, '') AS language,
         coalesce(signature, '') AS signature, coalesce(docstring, '') AS docstring, start_line, end_line
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, kind DESC NULLS LAST, name DESC NULLS LAST, qualified_name DESC NULLS LAST, path DESC, language DESC NULLS LAST,
               signature DESC NULLS LAST, docstring DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST) AS rn
        FROM symbols WHERE id IS NOT NULL AND path IS NOT NULL) WHERE rn = 1),
e AS (SELECT DISTINCT src_id, dst_id, kind FROM edges WHERE dst_id IS NOT NULL AND src_id IN (SELECT id FROM sym)),
fimp AS (SELECT DISTINCT e.src_id AS importer, e.dst_id AS imported FROM e JOIN sym a ON a.id = e.src_id AND a.kind = 'file' JOIN sym b ON b.id = e.dst_id AND b.kind = 'file' WHERE e.kind = 'imports')
"""
_MAP = " ".join(f"WHEN '{x}' THEN '{language}'" for x, language in EXTENSIONS.items())
_EXT = "lower(regexp_extract(path, '[^/]\\.([A-Za-z0-9_+-]+)$', 1))"
_EVENTS = "events AS (SELECT path, removed, seq FROM (SELECT path, coalesce(removed, false) AS removed, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC, coalesce(removed, false) DESC) AS rn FROM file_changes WHERE path IS NOT NULL AND seq IS NOT NULL) WHERE rn = 1)"


# sources, sinks and snapshots


@_query(f"SELECT DISTINCT path FROM documents WHERE {_EXT} IN ({', '.join(repr(x) for x in EXTENSIONS)}) AND NOT regexp_matches(path, '(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in IGNORED_DIRS)})/') AND NOT regexp_matches(path, '(^|/)\\.[^/]+/')")
def discover_files(spark, d):
    from arborine.sources.discovery import selected

    return selected(table(spark, d, "documents").select("path")).distinct()


@_query(f"SELECT ext, language, count(*) AS files, count(*) FILTER (WHERE coalesce(language, '') = coalesce(said, '')) AS agreeing FROM (SELECT {_EXT} AS ext, CASE {_EXT} {_MAP} END AS language, language AS said FROM parse_results WHERE path IS NOT NULL) GROUP BY ext, language")
def language_map(spark, d):
    rows = table(spark, d, "parse_results").where("path is not null").select(T.extension(F.col("path")).alias("ext"), language_for(F.col("path")).alias("language"), F.col("language").alias("said"))
    return rows.groupBy("ext", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("language", F.lit("")) == F.coalesce("said", F.lit(""))).alias("agreeing"))


@_query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE path IS NOT NULL AND text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("path is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@_query(f"WITH {_BASE} SELECT id, {_REST} FROM sym")
def upsert_nodes(spark, d):
    return nodes(spark, d)


@_query(f"WITH {_BASE.replace('docstring DESC NULLS LAST,', '')} SELECT id, kind, name, path, signature, '' AS docstring, start_line FROM sym")
def migrated_symbols(spark, d):
    """An older table without docstrings, brought to today's columns."""
    return S.upsert_nodes(S.migrated(table(spark, d, "symbols").drop("docstring"))).select("id", "kind", "name", "path", "signature", "docstring", "start_line")


@_query(f"WITH {_BASE} SELECT src_id, dst_id, kind FROM e")
def upsert_edges(spark, d):
    return edges(spark, d)


@_query(f"WITH {_BASE} SELECT DISTINCT dst_id AS id FROM e WHERE dst_id NOT IN (SELECT id FROM sym)")
def placeholder_nodes(spark, d):
    return S.placeholder_nodes(edges(spark, d), nodes(spark, d))


@_query(f"WITH {_EVENTS} SELECT path, removed, seq FROM events")
def event_collapse(spark, d):
    return S.collapse_events(table(spark, d, "file_changes"))


@_query(f"WITH {_BASE}, {_EVENTS}, gone AS (SELECT id FROM sym WHERE path IN (SELECT path FROM events WHERE removed)) SELECT src_id, dst_id, kind FROM e WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)")
def delete_cascade(spark, d):
    removed = S.collapse_events(table(spark, d, "file_changes")).where("removed").select("path")
    return S.delete_files(nodes(spark, d), edges(spark, d), removed)[1]


_ACTIONS = f"""{_EVENTS},
runs AS (SELECT path, content_hash, error, row_number() OVER (PARTITION BY path ORDER BY parsed_at DESC NULLS LAST, content_hash DESC NULLS LAST, error DESC NULLS LAST) AS rn,
         row_number() OVER (PARTITION BY path ORDER BY parsed_at NULLS FIRST, content_hash NULLS FIRST, error NULLS FIRST) AS first FROM parse_results WHERE path IS NOT NULL),
actions AS (SELECT ev.path, CASE WHEN ev.removed THEN 'delete' WHEN coalesce(n.error, '') <> '' OR n.content_hash IS NULL THEN 'keep' WHEN n.content_hash = b.content_hash THEN 'skip' ELSE 'replace' END AS action
FROM events ev LEFT JOIN runs n ON n.path = ev.path AND n.rn = 1 LEFT JOIN runs b ON b.path = ev.path AND b.first = 1)"""


def _actions(spark, d) -> DataFrame:
    runs = table(spark, d, "parse_results").where("path is not null")
    one = lambda f: runs.groupBy("path").agg(f(F.struct("parsed_at", "content_hash", "error")).alias("r")).select("path", "r.content_hash", "r.error")
    return S.update_actions(one(F.min).drop("error"), one(F.max), S.collapse_events(table(spark, d, "file_changes")))


@_query(f"WITH {_ACTIONS} SELECT path, action FROM actions")
def incremental_snapshot(spark, d):
    return _actions(spark, d)


_COLUMNS = "id, kind, name, qualified_name, path, language, signature, docstring, start_line, end_line"
_FIRST = _BASE[: _BASE.index("),\ne AS") + 2].replace("sym AS", "sym0 AS").replace(" DESC NULLS LAST", " NULLS FIRST").replace("path DESC", "path")
_UPDATED = f"""{_BASE[: _BASE.index(chr(10) + "e AS")].replace("sym AS", "last AS")}
{_FIRST.strip().rstrip(",")},
{_ACTIONS}, gone AS (SELECT id FROM sym0 WHERE path IN (SELECT path FROM actions WHERE action IN ('delete', 'replace'))),
added AS (SELECT {_COLUMNS} FROM last WHERE path IN (SELECT path FROM actions WHERE action = 'replace')),
sym AS (SELECT {_COLUMNS} FROM sym0 WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT {_COLUMNS} FROM added),
e AS (SELECT DISTINCT src_id, dst_id, kind FROM edges WHERE dst_id IS NOT NULL AND src_id IN (SELECT id FROM sym0) AND src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)
      UNION SELECT DISTINCT src_id, dst_id, kind FROM edges WHERE dst_id IS NOT NULL AND src_id IN (SELECT id FROM added))"""


def _update(spark, d) -> tuple[DataFrame, DataFrame]:
    """The first recorded graph after the events: files to replace take their latest rows."""
    symbols, rows = table(spark, d, "symbols"), table(spark, d, "edges")
    old, new = S.upsert_nodes(symbols, first=True), S.upsert_nodes(symbols)
    scratch = Scratch(spark, "update")
    n, e = S.apply_update(scratch.save(old, "old"), S.upsert_edges(rows, old), new, rows, scratch.save(_actions(spark, d), "actions"))
    return scratch.save(n, "nodes"), scratch.save(e, "edges")


@_query(f"WITH {_UPDATED} SELECT {_COLUMNS} FROM sym")
def incremental_update(spark, d):
    return _update(spark, d)[0]


@_query(f"WITH {_EVENTS} SELECT path, removed, seq FROM events WHERE {_EXT} IN ({', '.join(repr(x) for x in EXTENSIONS)}) AND NOT regexp_matches(path, '(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in IGNORED_DIRS)})/') AND NOT regexp_matches(path, '(^|/)\\.[^/]+/')")
def stream_changes(spark, d):
    scratch = Scratch(spark, "changes")
    state = ChangeState(spark, f"{scratch.path}/state")
    return run_available(change_stream(spark, f"{d}/file_changes.parque[t]"), state, f"{scratch.path}/progress")


@_query("SELECT kind, count(*) AS edges, count(DISTINCT dst_id) AS targets FROM edges WHERE weight IS NOT NULL GROUP BY kind")
def raw_query(spark, d):
    return spark.sql("SELECT kind, count(*) AS edges, count(DISTINCT dst_id) AS targets FROM {edges} WHERE weight IS NOT NULL OR :all GROUP BY kind", args={"all": False}, edges=table(spark, d, "edges"))


@_query()
def extract_symbols(spark, d):
    parsed = parse_files(table(spark, d, "documents").where("path is not null").select("path", "text"))
    return extracted_symbols(parsed).distinct()


@_query()
def extract_edges(spark, d):
    parsed = parse_files(table(spark, d, "documents").where("path is not null").select("path", "text"))
    return extracted_edges(parsed).distinct()


def _parsed(spark, d) -> DataFrame:
    return parse_files(table(spark, d, "documents").where("path is not null").select("path", "text"))


@_query("SELECT DISTINCT id, kind, start_line FROM symbols WHERE id IS NOT NULL AND path IN (SELECT path FROM documents WHERE path IS NOT NULL)")
def extract_known(spark, d):
    """What extraction finds of the recorded symbols: all of them, with their kind and line."""
    known = table(spark, d, "symbols").where("id is not null and path is not null").select("id", "kind", "start_line").distinct()
    return extracted_symbols(_parsed(spark, d)).select("id", "kind", "start_line").distinct().join(known, ["id", "kind", "start_line"], "left_semi")


@_query("SELECT DISTINCT id, signature FROM symbols WHERE id IS NOT NULL AND signature <> '' AND path IN (SELECT path FROM documents WHERE path IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')")
def extract_signatures(spark, d):
    """What extraction finds of the recorded signatures."""
    known = table(spark, d, "symbols").where("id is not null and path is not null and signature <> ''").select("id", "signature").distinct()
    return extracted_symbols(_parsed(spark, d)).select("id", "signature").distinct().join(known, ["id", "signature"], "left_semi")


@_query("SELECT DISTINCT src_id, dst_id, kind FROM edges WHERE kind IN ('imports', 'inherits') AND NOT contains(dst_id, '/') AND string_split(src_id, '::')[1] IN (SELECT path FROM documents WHERE path IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')")
def extract_references(spark, d):
    """What extraction finds of the recorded imports and bases by bare name."""
    known = table(spark, d, "edges").where("kind in ('imports', 'inherits') and not contains(dst_id, '/')").select("src_id", "dst_id", "kind").distinct()
    return extracted_edges(_parsed(spark, d)).select("src_id", "dst_id", "kind").distinct().join(known, ["src_id", "dst_id", "kind"], "left_semi")


# lookups


@_query(f"""WITH {_BASE}, names AS (SELECT DISTINCT dst_id AS query FROM e WHERE NOT contains(dst_id, '/')),
keys AS (SELECT id, id AS k FROM sym UNION SELECT id, name FROM sym UNION SELECT id, array_to_string(parts[i:], '.') FROM (SELECT id, string_split(qualified_name, '.') AS parts, unnest(range(1, 1 + len(string_split(qualified_name, '.')))) AS i FROM sym WHERE qualified_name <> ''))
SELECT query, id FROM names JOIN keys ON k = query""")
def symbol_match(spark, d):
    names = edges(spark, d).where(~F.col("dst_id").contains("/")).select(F.col("dst_id").alias("query"))
    return L.match_symbols(nodes(spark, d), names)


@_query(f"WITH {_BASE} SELECT e.src_id, e.dst_id, coalesce(nullif(s.name, ''), s.id) AS name, s.kind, s.path, s.start_line FROM e JOIN sym s ON s.id = e.dst_id WHERE e.kind = 'calls' AND s.path <> ''")
def callees(spark, d):
    return L.callees(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT e.dst_id, e.src_id, coalesce(nullif(s.name, ''), s.id) AS name, s.kind, s.path, s.start_line FROM e JOIN sym s ON s.id = e.src_id WHERE e.kind = 'calls' AND s.path <> ''")
def callers(spark, d):
    return L.callers(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT c.id AS class_id, s.id, coalesce(nullif(s.name, ''), s.id) AS name, s.path FROM e JOIN sym c ON c.id = e.src_id AND c.kind = 'class' JOIN sym s ON s.id = e.dst_id WHERE e.kind = 'inherits'")
def class_supertypes(spark, d):
    return L.supertypes(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT c.id AS class_id, s.id, coalesce(nullif(s.name, ''), s.id) AS name, s.path FROM e JOIN sym c ON c.id = e.dst_id AND c.kind = 'class' JOIN sym s ON s.id = e.src_id WHERE e.kind = 'inherits'")
def class_subtypes(spark, d):
    return L.subtypes(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT e.src_id AS path, e.dst_id AS id FROM e JOIN sym f ON f.id = e.src_id AND f.kind = 'file' LEFT JOIN sym t ON t.id = e.dst_id AND t.kind = 'file' WHERE e.kind = 'imports' AND t.id IS NULL")
def file_dependencies(spark, d):
    return L.file_dependencies(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT e.dst_id AS path, e.src_id AS id FROM e JOIN sym f ON f.id = e.dst_id AND f.kind = 'file' WHERE e.kind = 'imports'")
def file_dependents(spark, d):
    return L.file_dependents(nodes(spark, d), edges(spark, d))


@_query(f"WITH {_BASE} SELECT importer, imported FROM fimp")
def file_imports(spark, d):
    return L.file_imports(nodes(spark, d), edges(spark, d))


@_query(f"""WITH {_BASE}, st AS (SELECT src_id AS a, dst_id AS b FROM e WHERE kind = 'inherits' UNION SELECT dst_id, src_id FROM e WHERE kind = 'inherits'),
seeds AS (SELECT id FROM sym WHERE kind = 'class'), one AS (SELECT DISTINCT id AS seed, b AS id FROM seeds JOIN st ON a = id WHERE b <> id),
two AS (SELECT DISTINCT seed, st.b AS id FROM one JOIN st ON st.a = one.id WHERE st.b <> seed)
SELECT seed, id, CAST(1 AS BIGINT) AS depth FROM one UNION ALL SELECT seed, id, CAST(2 AS BIGINT) FROM two WHERE (seed, id) NOT IN (SELECT (seed, id) FROM one)""")
def graph_expand(spark, d):
    return L.neighbours(edges(spark, d), nodes(spark, d).where("kind = 'class'").select("id"), ("inherits",), depth=2)


@_query(f"WITH {_BASE} SELECT src_id AS seed, dst_id AS id, CAST(1 AS BIGINT) AS depth FROM e WHERE src_id <> dst_id UNION SELECT dst_id, src_id, CAST(1 AS BIGINT) FROM e WHERE src_id <> dst_id")
def graph_expand_all(spark, d):
    return L.all_neighbours(edges(spark, d))


@_query(rf"""WITH {_BASE} SELECT path, coalesce((SELECT min(f.language) FROM sym f WHERE f.kind = 'file' AND f.path = o.path), '') AS language, id, kind, name, signature, start_line, end_line,
coalesce(CASE WHEN length(line) > 120 THEN line[:119] || '…' ELSE line END, '') AS summary, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS FIRST, id) AS place
FROM (SELECT *, trim(regexp_split_to_array(regexp_replace(docstring, '^\s+|\s+$', '', 'g'), '\r\n|[\n\r]')[1]) AS line FROM sym) o WHERE kind <> 'file'""")
def file_outline(spark, d):
    return L.file_outline(nodes(spark, d))


@_query(rf"""WITH {_BASE}, texts AS (SELECT path, text FROM (SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY fetched_at DESC NULLS LAST, text DESC) AS rn FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) WHERE rn = 1),
cut AS (SELECT s.id, s.path, s.start_line AS a, s.end_line AS b, t.text, regexp_split_to_array(t.text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM sym s LEFT JOIN texts t ON t.path = s.path WHERE s.kind <> 'file')
SELECT id, path, CASE WHEN text IS NOT NULL AND a >= 1 AND b >= a THEN array_to_string((CASE WHEN lines[len(lines)] = '' THEN lines[:len(lines) - 1] ELSE lines END)[a:b], chr(10)) ELSE '' END AS source FROM cut""")
def read_symbol(spark, d):
    return L.read_symbol(nodes(spark, d), table(spark, d, "documents").select("path", "text", "fetched_at"), "fetched_at")


@_query(f"WITH {_BASE} SELECT count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind <> 'file') AS symbols FROM sym WHERE path <> ''")
def overview_counts(spark, d):
    return L.overview(nodes(spark, d))


@_query(f"WITH {_BASE} SELECT language, count(*) AS files FROM sym WHERE kind = 'file' AND language <> '' GROUP BY language")
def language_mix(spark, d):
    return L.language_mix(nodes(spark, d))


@_query(f"WITH {_BASE} SELECT imported AS path, count(*) AS dependents FROM fimp GROUP BY imported ORDER BY dependents DESC, path LIMIT 15")
def hub_files(spark, d):
    return L.hubs(nodes(spark, d), edges(spark, d))


# resolution


_IMPORTS = r"""files AS (SELECT id, qualified_name AS q FROM sym WHERE kind = 'file' AND qualified_name <> ''),
ends AS (SELECT id, q, array_to_string(parts[i:], '.') AS t FROM (SELECT id, q, string_split(q, '.') AS parts, unnest(range(1, 1 + len(string_split(q, '.')))) AS i FROM files)),
idx AS (SELECT t, coalesce(max(id) FILTER (WHERE q = t), CASE WHEN count(DISTINCT id) = 1 THEN min(id) END) AS dst FROM ends GROUP BY t),
wanted AS (SELECT DISTINCT src_id, regexp_replace(dst_id, '^["''`;<>]+|["''`;<>]+$', '', 'g') AS t FROM e WHERE kind = 'imports' AND dst_id NOT IN (SELECT id FROM sym WHERE kind = 'file')),
links AS (SELECT DISTINCT src_id, dst AS dst_id FROM wanted JOIN idx USING (t) WHERE dst IS NOT NULL AND dst <> src_id)"""


@_query(f"WITH {_BASE}, {_IMPORTS} SELECT src_id, dst_id FROM links")
def resolve_imports(spark, d):
    return R.resolve_imports(nodes(spark, d), edges(spark, d))


def _names(kind: str, kinds: str, other: str, edges: str = "e", tag: str = "") -> str:
    return f"""asked{tag} AS (SELECT DISTINCT e.src_id, e.dst_id AS name, s.path AS src_path FROM {edges} e JOIN sym s ON s.id = e.src_id WHERE e.kind = '{kind}' AND NOT contains(e.dst_id, '/') AND s.path <> ''),
cand{tag} AS (SELECT a.src_id, a.name, c.id, CASE WHEN c.path = a.src_path THEN 0 WHEN f.imported IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM asked{tag} a JOIN sym c ON c.name = a.name AND c.kind IN ({kinds}) AND c.path <> '' {other} LEFT JOIN fimp f ON f.importer = a.src_path AND f.imported = c.path),
best{tag} AS (SELECT *, min(tier) OVER (PARTITION BY src_id, name) AS t FROM cand{tag}),
settled{tag} AS (SELECT src_id, name, min(id) AS dst_id FROM best{tag} WHERE tier = t GROUP BY src_id, name HAVING count(DISTINCT id) = 1)"""


_CALLED, _EXTENDED = ("calls", "'function', 'method', 'class'", ""), ("inherits", "'class'", "AND c.id <> a.src_id")


@_query(f"""WITH {_UPDATED}, {_IMPORTS}, known AS (SELECT src_id, dst_id, kind FROM e UNION SELECT src_id, dst_id, 'imports' FROM links),
fimp AS (SELECT DISTINCT e.src_id AS importer, e.dst_id AS imported FROM known e JOIN sym a ON a.id = e.src_id AND a.kind = 'file' JOIN sym b ON b.id = e.dst_id AND b.kind = 'file' WHERE e.kind = 'imports'),
{_names(*_CALLED, "known", "_c")}, {_names(*_EXTENDED, "known", "_i")}
SELECT src_id, dst_id, kind FROM known UNION SELECT src_id, dst_id, 'calls' FROM settled_c UNION SELECT src_id, dst_id, 'inherits' FROM settled_i""")
def incremental_edges(spark, d):
    return R.resolved(*_update(spark, d), Scratch(spark, "resolution"))


@_query(f"WITH {_BASE}, {_names(*_CALLED)} SELECT src_id, name, dst_id FROM settled")
def resolve_calls(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return R.resolve_calls(n, e, L.file_imports(n, e))


@_query(f"WITH {_BASE}, {_names(*_EXTENDED)} SELECT src_id, name, dst_id FROM settled")
def resolve_inheritance(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return R.resolve_inheritance(n, e, L.file_imports(n, e))


# traversal

_CHANGED = "changed AS (SELECT DISTINCT path FROM file_changes WHERE path IS NOT NULL)"
_REACH = f"""WITH RECURSIVE {_BASE}, {_CHANGED}, st AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM e WHERE kind IN ('calls', 'inherits') AND src_id IN (SELECT id FROM sym WHERE path <> '')),
seeds AS (SELECT id FROM sym WHERE kind <> 'file' AND path IN (SELECT path FROM changed)),
r AS (SELECT id AS seed, id, 0 AS d FROM seeds UNION SELECT r.seed, st.src, r.d + 1 FROM r JOIN st ON st.dst = r.id WHERE r.d < 4),
reach AS (SELECT q.seed, q.id, s.path, CAST(q.d AS BIGINT) AS depth, regexp_matches(lower(s.path), 'test|spec') AS is_test FROM (SELECT seed, id, min(d) AS d FROM r WHERE id <> seed GROUP BY seed, id) q JOIN sym s ON s.id = q.id WHERE s.path <> '')"""
_BLAST = f"""WITH RECURSIVE {_BASE}, {_CHANGED}, st AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM e WHERE kind = 'imports'),
r AS (SELECT path AS seed, path AS id, 0 AS d FROM changed UNION SELECT r.seed, st.src, r.d + 1 FROM r JOIN st ON st.dst = r.id WHERE r.d < 3),
reach AS (SELECT seed, id, CAST(min(d) AS BIGINT) AS depth, contains(lower(id), 'test') AS is_test FROM r WHERE id <> seed GROUP BY seed, id)"""


def _changed_paths(spark, d) -> DataFrame:
    return table(spark, d, "file_changes").where("path is not null").select("path").distinct()


def _changed_symbols(spark, d) -> DataFrame:
    return X.impacted_symbols(nodes(spark, d), _changed_paths(spark, d)).select("id")


def _symbol_reach(spark, d) -> DataFrame:
    return X.symbol_impact(nodes(spark, d), edges(spark, d), _changed_symbols(spark, d))


def _file_reach(spark, d) -> DataFrame:
    return X.blast_radius(edges(spark, d), _changed_paths(spark, d).withColumnRenamed("path", "id"))


@_query(f"{_REACH} SELECT seed, id, path, depth, is_test FROM reach")
def symbol_impact(spark, d):
    return _symbol_reach(spark, d)


@_query(f"{_BLAST} SELECT seed, id, depth, is_test FROM reach")
def blast_radius(spark, d):
    return _file_reach(spark, d)


@_query(f"WITH {_BASE} SELECT path, id, qualified_name FROM sym WHERE kind <> 'file' AND path IN (SELECT path FROM file_changes)")
def impacted_symbols(spark, d):
    return X.impacted_symbols(nodes(spark, d), _changed_paths(spark, d))


@_query(ORACLE["blast_radius"])
def changed_files_reach(spark, d):
    return _file_reach(spark, d)


@_query(ORACLE["symbol_impact"])
def changed_symbols_reach(spark, d):
    return _symbol_reach(spark, d)


@_query(f"""{_REACH} SELECT s.id AS seed, count(r.id) AS impacted, count(DISTINCT r.path) AS files, count(DISTINCT r.path) FILTER (WHERE r.is_test) AS tests, coalesce(max(r.depth), 0) AS max_depth
FROM seeds s LEFT JOIN reach r ON r.seed = s.id GROUP BY s.id""")
def impact_report(spark, d):
    return X.reach_report(_symbol_reach(spark, d), _changed_symbols(spark, d))


@_query(f"{_REACH} SELECT DISTINCT seed, path FROM reach WHERE is_test")
def affected_tests(spark, d):
    return X.affected_tests(_symbol_reach(spark, d))


@_query(f"""{_BLAST} SELECT c.path AS seed, count(r.id) AS impacted, count(DISTINCT r.id) AS files, count(DISTINCT r.id) FILTER (WHERE r.is_test) AS tests, coalesce(max(r.depth), 0) AS max_depth
FROM changed c LEFT JOIN reach r ON r.seed = c.path GROUP BY c.path""")
def blast_report(spark, d):
    return X.reach_report(_file_reach(spark, d), _changed_paths(spark, d).withColumnRenamed("path", "id"), "id")


# scalars


@_query("SELECT doc_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@_query(r"SELECT DISTINCT path, regexp_replace(replace(regexp_replace(path, '([^/])\.[^./]*$', '\1'), '/', '.'), '(^|\.)__init__$', '') AS qualified_name FROM parse_results WHERE path IS NOT NULL")
def module_qualname(spark, d):
    return table(spark, d, "parse_results").where("path is not null").select("path", T.module_qualname(F.col("path")).alias("qualified_name")).distinct()


@_query(f"WITH {_BASE} SELECT id, array_to_string(parts[i:], '.') AS suffix FROM (SELECT id, string_split(qualified_name, '.') AS parts, unnest(range(1, 1 + len(string_split(qualified_name, '.')))) AS i FROM sym WHERE kind = 'file' AND qualified_name <> '')")
def dotted_suffixes(spark, d):
    return nodes(spark, d).where("kind = 'file'").select("id", F.explode(T.dotted_suffixes(F.col("qualified_name"))).alias("suffix"))


@_query("""SELECT DISTINCT dst_id AS target, regexp_replace(dst_id, '^["''`;<>]+|["''`;<>]+$', '', 'g') AS cleaned FROM edges WHERE kind = 'imports' AND dst_id IS NOT NULL""")
def clean_import(spark, d):
    return table(spark, d, "edges").where("kind = 'imports' and dst_id is not null").select(F.col("dst_id").alias("target"), T.clean_import(F.col("dst_id")).alias("cleaned")).distinct()


@_query(f"WITH {_BASE} SELECT id, CASE WHEN length(docstring) > 500 THEN docstring[:499] || '…' ELSE docstring END AS docstring FROM sym WHERE docstring <> ''")
def docstring_cap(spark, d):
    return nodes(spark, d).where("docstring <> ''").select("id", T.docstring_cap(F.col("docstring")).alias("docstring"))


@_query("SELECT path, contains(lower(path), 'test') AS test_file, regexp_matches(lower(path), 'test|spec') AS test_symbol FROM (SELECT DISTINCT path FROM parse_results WHERE path IS NOT NULL)")
def is_test_file(spark, d):
    return table(spark, d, "parse_results").where("path is not null").select("path").distinct().select("path", T.is_test_file(F.col("path")).alias("test_file"), T.is_test_symbol(F.col("path")).alias("test_symbol"))


@_query(r"SELECT event_id, CASE WHEN regexp_matches(regexp_extract(props, ':\s*\"?([^,}\"]*)', 1), '^[+-]?\d+$') THEN CAST(regexp_extract(props, ':\s*\"?([^,}\"]*)', 1) AS BIGINT) ELSE 0 END AS n FROM events")
def as_int(spark, d):
    return table(spark, d, "events").select("event_id", T.as_int(F.regexp_extract("props", r":\s*\"?([^,}\"]*)", 1)).alias("n"))


_WORDS = r"list_transform(regexp_extract_all(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w))"


@_query(rf"SELECT name, unnest(words) AS word, unnest(range(1, 1 + len(words))) AS pos FROM (SELECT x AS name, {_WORDS} AS words FROM (SELECT DISTINCT name AS x FROM symbols WHERE name IS NOT NULL))")
def identifier_split(spark, d):
    names = table(spark, d, "symbols").where("name is not null").select("name").distinct()
    return names.select("name", F.posexplode(T.identifier_split(F.col("name"))).alias("p", "word")).select("name", "word", (F.col("p") + 1).cast("long").alias("pos"))


_FEATURES = rf"""tok AS (SELECT name, unnest(regexp_extract_all(name, '[A-Za-z0-9]+')) AS x FROM (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL)),
tokn AS (SELECT name, x, row_number() OVER () AS t FROM tok),
w AS (SELECT name, t, unnest(list_distinct(list_concat([lower(x)], {_WORDS}))) AS word FROM tokn),
f AS (SELECT name, 'w:' || word AS feature FROM w UNION ALL SELECT name, '3:' || ('#' || word || '#')[i:i + 2] FROM (SELECT name, word, unnest(range(1, 1 + length(word))) AS i FROM w))"""


@_query(f"WITH {_FEATURES} SELECT name, feature, count(*) AS n FROM f GROUP BY name, feature")
def text_features(spark, d):
    names = table(spark, d, "symbols").where("name is not null").select("name").distinct()
    return names.select("name", F.explode(T.text_features(F.col("name"))).alias("feature")).groupBy("name", "feature").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_FEATURES}, b AS (SELECT name, CAST(('0x' || substr(md5(feature), 1, 15))::BIGINT % 384 AS BIGINT) AS bucket, CASE WHEN substr(md5(feature), 16, 1) IN ('0','1','2','3','4','5','6','7') THEN 1.0 ELSE -1.0 END AS s FROM f),
v AS (SELECT name, bucket, sum(s) AS v FROM b GROUP BY name, bucket HAVING sum(s) <> 0)
SELECT name, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY name)), 6) AS value FROM v""")
def hashing_embed(spark, d):
    names = table(spark, d, "symbols").where("name is not null").select("name").distinct()
    bucket, sign = native_places(F.col("feature"), 384)
    sums = names.select("name", F.explode(T.text_features(F.col("name"))).alias("feature")).groupBy("name", bucket.alias("bucket")).agg(F.sum(sign).alias("v")).where("v <> 0")
    return sums.select("name", "bucket", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("name"))), 6).alias("value"))


# retrieval and reports


_DISTANCE = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _nearest(where: str = "true") -> str:
    return f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DISTANCE} AS dist FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}),
hits AS (SELECT query_id, id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM p) WHERE rank <= 20)"""


def _embedded(spark, d) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.where("id % 50 = 0")


@_query(f"{_nearest()} SELECT query_id, id, round(dist, 6) AS distance, rank FROM hits")
def knn_search(spark, d):
    return V.knn(*_embedded(spark, d)).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@_query(f"{_nearest('v.label % 2 = 1')} SELECT query_id, id, round(dist, 6) AS distance, rank FROM hits")
def knn_where(spark, d):
    return V.knn(*_embedded(spark, d), where="label % 2 = 1").select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@_query()
def knn_indexed(spark, d):
    return V.knn_indexed(*_embedded(spark, d)).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@_query()
def knn_recall(spark, d):
    v, q = _embedded(spark, d)
    return V.recall(V.knn_indexed(v, q), V.knn(v, q))


@_query(f"{_nearest()} SELECT id, round(max(1 / (1 + dist)), 6) AS score FROM hits GROUP BY id")
def seed_scores(spark, d):
    hits = V.knn(*_embedded(spark, d)).select(F.lit(0).alias("prompt_id"), "id", "distance")
    return V.seed_scores(hits).select("id", F.round("score", 6).alias("score"))


@_query("""WITH v AS (SELECT vec_id::VARCHAR AS id, 'cluster/' || label AS path, 'item ' || vec_id AS text, embedding FROM embeddings), moved AS (SELECT 'new-' || id AS id, path, text, embedding FROM v WHERE path IN ('cluster/1', 'cluster/2'))
SELECT id, path, text, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS dim FROM (SELECT * FROM v WHERE path NOT IN ('cluster/0', 'cluster/1', 'cluster/2') UNION ALL SELECT * FROM moved)""")
def vector_table(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("cluster/"), F.col("label")).alias("path"), F.concat(F.lit("item "), F.col("vec_id")).alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    held = VectorTable(spark, f"{Scratch(spark, 'vectors').path}/table", 64)
    held.upsert(rows)
    held.upsert(rows.where("path in ('cluster/1', 'cluster/2')").withColumn("id", F.concat(F.lit("new-"), F.col("id"))))
    held.delete(rows.where("path = 'cluster/0'").select("path"))
    return held.read().select("id", "path", "text", F.round(F.element_at("vector", 1), 6).alias("first"), F.size("vector").cast("long").alias("dim"))


@_query(f"WITH {_BASE} SELECT id, path, coalesce(nullif(signature, ''), qualified_name) AS text, CAST(384 AS BIGINT) AS dim, CAST(0 AS DOUBLE) AS norm FROM sym")
def null_vectors(spark, d):
    v = V.symbol_vectors(nodes(spark, d), null_embedder())
    return v.select("id", "path", "text", F.size("vector").cast("long").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))


@_query(f"""WITH {_BASE} SELECT id, path, coalesce(nullif(signature, ''), qualified_name) AS text, CAST(384 AS BIGINT) AS dim, CASE WHEN regexp_matches(coalesce(nullif(signature, ''), qualified_name), '[A-Za-z0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM sym""")
def symbol_vectors(spark, d):
    v = V.symbol_vectors(nodes(spark, d))
    return v.select("id", "path", "text", F.size("vector").cast("long").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@_query()
def prune_context(spark, d):
    n = nodes(spark, d)
    prompts = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("prompt_id"), F.col("text").cast("string").alias("prompt"))
    return V.prune_context(n, edges(spark, d), V.symbol_vectors(n), prompts, token_budget=8000)


@_query(f"""WITH {_BASE}, c AS (SELECT path, id, start_line, CAST(greatest(1, length(coalesce(nullif(signature, ''), name)) // 4) AS BIGINT) AS cost FROM sym WHERE kind <> 'file'),
r AS (SELECT path, id, cost, CAST(sum(cost) OVER (PARTITION BY path ORDER BY start_line NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS FIRST, id) AS rank FROM c)
SELECT path, id, cost, total, rank FROM r WHERE total <= {BUDGET} OR rank = 1""")
def budget_prefix(spark, d):
    c = nodes(spark, d).where("kind <> 'file'").withColumn("cost", T.estimate_tokens(F.coalesce(F.nullif("signature", F.lit("")), "name")))
    return V.budget_prefix(c, "path", ["start_line", "id"], "cost", BUDGET).select("path", "id", "cost", "total", "rank")


@_query(f"WITH {_BASE}, r AS (SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY id) AS rank FROM sym) SELECT language AS prompt_id, path, min(rank) AS rank FROM r WHERE path <> '' GROUP BY language, path")
def context_files(spark, d):
    rows = nodes(spark, d).select(F.col("language").alias("prompt_id"), "path", "id")
    return V.context_files(ranked(rows, "prompt_id", ["id"], Scratch(spark, "files")))


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY parsed_at DESC NULLS LAST, content_hash DESC NULLS LAST, n_nodes DESC NULLS LAST, n_edges DESC NULLS LAST, error DESC NULLS LAST) AS rn FROM parse_results WHERE path IS NOT NULL)
SELECT count(*) AS files, CAST(coalesce(sum(n_nodes), 0) AS BIGINT) AS nodes, CAST(coalesce(sum(n_edges), 0) AS BIGINT) AS edges, count(*) FILTER (WHERE coalesce(error, '') <> '') AS errors FROM r WHERE rn = 1""")
def index_stats(spark, d):
    return M.index_stats(table(spark, d, "parse_results"))


@_query("SELECT event_type, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return M.percentiles(table(spark, d, "events"), "event_type", "value")


@_query(f"""WITH {_BASE}, t AS (SELECT path, CAST(max(greatest(1, length(coalesce(text, '')) // 4)) AS DOUBLE) AS n FROM documents WHERE path IS NOT NULL GROUP BY path),
o AS (SELECT path, CAST(sum(greatest(1, length(signature) // 4)) AS DOUBLE) AS m FROM sym WHERE kind <> 'file' GROUP BY path)
SELECT round(quantile_cont(n / m, 0.5), 1) AS median, round(avg(n / m), 1) AS mean FROM t JOIN o USING (path) WHERE n > 0 AND m > 0""")
def token_reduction(spark, d):
    texts = table(spark, d, "documents").where("path is not null").groupBy("path").agg(F.max(T.estimate_tokens(F.col("text"))).cast("double").alias("baseline"))
    told = nodes(spark, d).where("kind <> 'file'").groupBy("path").agg(F.sum(T.estimate_tokens(F.col("signature"))).cast("double").alias("returned"))
    return M.token_reduction(texts.join(told, "path"))


@_query(f"""WITH {_BASE}, f AS (SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM sym WHERE kind = 'file')
SELECT language, id FROM f WHERE n <= 50 OR i IN (SELECT CAST(floor(k * n / 50) AS BIGINT) FROM range(50) r(k))""")
def stride_sample(spark, d):
    return M.stride_sample(nodes(spark, d).where("kind = 'file'").select("id", "language"), "language", "id", 50).select("language", "id")


# the tools of the graph object, each for all names or files at once


def _graph(spark, d) -> CodeGraph:
    texts = table(spark, d, "documents").where("path is not null and text is not null").groupBy("path").agg(F.max(F.struct("fetched_at", "text")).alias("t")).select("path", "t.text")
    return CodeGraph(spark, table(spark, d, "symbols"), table(spark, d, "edges"), texts)


def _called_names(spark, d) -> DataFrame:
    return table(spark, d, "edges").where("kind = 'calls' and not contains(dst_id, '/')").select("dst_id").distinct()


_KEYS = """names AS (SELECT DISTINCT dst_id AS query FROM edges WHERE kind = 'calls' AND NOT contains(dst_id, '/')),
keys AS (SELECT id, id AS k FROM sym UNION SELECT id, name FROM sym UNION SELECT id, array_to_string(parts[i:], '.') FROM (SELECT id, string_split(qualified_name, '.') AS parts, unnest(range(1, 1 + len(string_split(qualified_name, '.')))) AS i FROM sym WHERE qualified_name <> '')),
matched AS (SELECT query, id, path AS mpath, start_line AS mline FROM names JOIN keys ON k = query JOIN sym USING (id) WHERE sym.kind <> 'file')"""


@_query(f"WITH {_BASE}, {_KEYS} SELECT m.query, e.dst_id, e.src_id, coalesce(nullif(s.name, ''), s.id) AS name, s.path FROM matched m JOIN e ON e.dst_id = m.id AND e.kind = 'calls' JOIN sym s ON s.id = e.src_id WHERE s.path <> ''")
def tool_callers(spark, d):
    return _graph(spark, d).get_callers(_called_names(spark, d)).select("query", "dst_id", "src_id", "name", "path")


@_query(f"WITH {_BASE}, {_KEYS} SELECT m.query, e.src_id, e.dst_id, coalesce(nullif(s.name, ''), s.id) AS name, s.path FROM matched m JOIN e ON e.src_id = m.id AND e.kind = 'calls' JOIN sym s ON s.id = e.dst_id WHERE s.path <> ''")
def tool_callees(spark, d):
    return _graph(spark, d).get_callees(_called_names(spark, d)).select("query", "src_id", "dst_id", "name", "path")


@_query(f"""WITH {_BASE}, bases AS (SELECT DISTINCT dst_id AS query FROM edges WHERE kind = 'inherits' AND NOT contains(dst_id, '/')),
m AS (SELECT DISTINCT b.query, c.id AS class_id FROM bases b JOIN sym c ON c.kind <> 'file' AND (c.name = b.query OR c.id = b.query OR c.qualified_name = b.query OR ends_with(c.qualified_name, '.' || b.query))),
h AS (SELECT e.src_id AS class_id, s.id, 'supertype' AS direction FROM e JOIN sym c ON c.id = e.src_id AND c.kind = 'class' JOIN sym s ON s.id = e.dst_id WHERE e.kind = 'inherits'
      UNION ALL SELECT e.dst_id, s.id, 'subtype' FROM e JOIN sym c ON c.id = e.dst_id AND c.kind = 'class' JOIN sym s ON s.id = e.src_id WHERE e.kind = 'inherits')
SELECT m.query, h.class_id, h.id, h.direction FROM m JOIN h USING (class_id)""")
def tool_class_hierarchy(spark, d):
    names = table(spark, d, "edges").where("kind = 'inherits' and not contains(dst_id, '/')").select("dst_id").distinct()
    return _graph(spark, d).class_hierarchy(names).select("query", "class_id", "id", "direction")


@_query(f"""WITH {_BASE}, f AS (SELECT DISTINCT path FROM file_changes WHERE path IS NOT NULL)
SELECT e.src_id AS path, e.dst_id AS id, 'dependency' AS direction FROM e JOIN sym s ON s.id = e.src_id AND s.kind = 'file' LEFT JOIN sym t ON t.id = e.dst_id AND t.kind = 'file' WHERE e.kind = 'imports' AND t.id IS NULL AND e.src_id IN (SELECT path FROM f)
UNION ALL SELECT e.dst_id, e.src_id, 'dependent' FROM e JOIN sym s ON s.id = e.dst_id AND s.kind = 'file' WHERE e.kind = 'imports' AND e.dst_id IN (SELECT path FROM f)""")
def tool_file_dependencies(spark, d):
    return _graph(spark, d).get_file_dependencies(_changed_paths(spark, d))


@_query(ORACLE["file_outline"].replace("o WHERE kind <> 'file'", "o WHERE kind <> 'file' AND path IN (SELECT path FROM file_changes)"))
def tool_file_outline(spark, d):
    return _graph(spark, d).file_outline(_changed_paths(spark, d))


@_query(rf"""WITH {_BASE}, {_KEYS}, texts AS (SELECT path, text FROM (SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY fetched_at DESC NULLS LAST, text DESC) AS rn FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) WHERE rn = 1),
top AS (SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mpath, mline NULLS FIRST, id) AS rn FROM (SELECT DISTINCT * FROM matched)) WHERE rn <= 5),
cut AS (SELECT p.query, s.id, s.path, s.start_line AS a, s.end_line AS b, t.text, regexp_split_to_array(t.text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM top p JOIN sym s USING (id) LEFT JOIN texts t ON t.path = s.path)
SELECT query, id, path, CASE WHEN text IS NOT NULL AND a >= 1 AND b >= a THEN array_to_string((CASE WHEN lines[len(lines)] = '' THEN lines[:len(lines) - 1] ELSE lines END)[a:b], chr(10)) ELSE '' END AS source FROM cut""")
def tool_read_symbol(spark, d):
    return _graph(spark, d).read_symbol(_called_names(spark, d))


@_query(f"WITH {_BASE} SELECT 'files' AS what, count(*) AS n FROM sym WHERE kind = 'file' AND path <> '' UNION ALL SELECT 'symbols', count(*) FROM sym WHERE kind <> 'file' AND path <> '' UNION ALL SELECT language, count(*) FROM sym WHERE kind = 'file' AND language <> '' GROUP BY 1 UNION ALL (SELECT imported, count(*) AS n FROM fimp GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)")
def tool_repo_overview(spark, d):
    counts, languages, hubs = _graph(spark, d).repo_overview()
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("files", "symbols")))).alias("r")).select("r.*")
    return long.unionByName(languages.toDF("what", "n")).unionByName(hubs.toDF("what", "n"))


@_query(ORACLE["blast_radius"])
def tool_blast_radius(spark, d):
    return _graph(spark, d).analyze_blast_radius(_changed_paths(spark, d))


@_query(ORACLE["symbol_impact"])
def tool_symbol_impact(spark, d):
    return _graph(spark, d).analyze_symbol_impact(_changed_symbols(spark, d))


@_query()
def tool_search(spark, d):
    prompts = table(spark, d, "documents").where("doc_id % 50 = 0 and text is not null").select("text").distinct()
    return _graph(spark, d).search_architecture_graph(prompts).select(F.md5("prompt_id").alias("prompt"), "id", "score", "rank")
