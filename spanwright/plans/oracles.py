"""The registered queries' rows in SQL over the same tables, written without regard to the operators."""

from __future__ import annotations

import re

from .graph import prefix

_CHAIN = """chain(source, scope_id, ancestor_id, distance) AS (
  SELECT source, scope_id, scope_id, 0 FROM g_scopes
  UNION ALL SELECT c.source, c.scope_id, s.parent_id, c.distance + 1
  FROM chain c JOIN g_scopes s ON s.source = c.source AND s.scope_id = c.ancestor_id WHERE s.parent_id IS NOT NULL)"""

_CANONICAL = """canonical AS (
  SELECT d.source, min(d.decl_id) AS decl_id, concat_ws('.', f.package, d.name) AS canonical
  FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0 GROUP BY d.source, f.package, d.name)"""

_REFS = """refs AS (SELECT source, decl_id AS ref_id, scope_id, type_name AS name FROM g_decls WHERE type_name IS NOT NULL)"""


def _stages(refs: str = "refs", tag: str = "") -> str:
    return f"""lexical{tag} AS (
  SELECT source, ref_id, target_source, target_id FROM (
    SELECT r.source, r.ref_id, r.source AS target_source, d.decl_id AS target_id, rank() OVER (PARTITION BY r.source, r.ref_id ORDER BY c.distance) AS k
    FROM {refs} r JOIN chain c ON c.source = r.source AND c.scope_id = r.scope_id
    JOIN g_decls d ON d.source = r.source AND d.scope_id = c.ancestor_id AND d.name = r.name AND d.kind = 'TYPE') WHERE k = 1),
exact{tag} AS (
  SELECT DISTINCT r.source, r.ref_id, k.source AS target_source, k.decl_id AS target_id
  FROM {refs} r JOIN g_imports i ON i.source = r.source AND i.kind = 'TYPE' AND regexp_extract(i.name, '[^.]*$') = r.name
  JOIN canonical k ON k.canonical = i.name),
package{tag} AS (
  SELECT r.source, r.ref_id, d.source AS target_source, d.decl_id AS target_id
  FROM {refs} r JOIN g_files f ON f.source = r.source
  JOIN (SELECT d.source, d.decl_id, d.name, f.package FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0) d
    ON d.name = r.name AND d.package IS NOT DISTINCT FROM f.package),
staged{tag} AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT *, 1 AS stage FROM lexical{tag}
    UNION ALL SELECT *, 2 FROM exact{tag} e WHERE NOT EXISTS (SELECT 1 FROM lexical{tag} l WHERE l.source = e.source AND l.ref_id = e.ref_id)
    UNION ALL SELECT *, 3 FROM package{tag} p WHERE NOT EXISTS (SELECT 1 FROM lexical{tag} l WHERE l.source = p.source AND l.ref_id = p.ref_id)
      AND NOT EXISTS (SELECT 1 FROM exact{tag} e WHERE e.source = p.source AND e.ref_id = p.ref_id)))"""


_VARIABLES = """variables AS MATERIALIZED (
  SELECT source, ref_id, source AS target_source, target_id, target_kind FROM (
    SELECT n.source, n.node_id AS ref_id, d.decl_id AS target_id, d.kind AS target_kind, rank() OVER (PARTITION BY n.source, n.node_id ORDER BY c.distance) AS k
    FROM g_nodes n JOIN chain c ON c.source = n.source AND c.scope_id = n.scope_id
    JOIN g_decls d ON d.source = n.source AND d.scope_id = c.ancestor_id AND d.name = n.name
    WHERE n.kind = 'NAME_REF' AND (d.kind = 'FIELD' OR d.kind = 'LOCAL' AND d.name_start <= n.name_start)) WHERE k = 1)"""

_ENCLOSING = """enclosing AS (
  SELECT source, scope_id, type_id FROM (
    SELECT c.source, c.scope_id, d.decl_id AS type_id, row_number() OVER (PARTITION BY c.source, c.scope_id ORDER BY c.distance) AS k
    FROM chain c JOIN g_scopes s ON s.source = c.source AND s.scope_id = c.ancestor_id
    JOIN g_decls d ON d.source = s.source AND d.decl_id = s.owner_id AND d.kind = 'TYPE') WHERE k = 1)"""

_RECEIVERS = (
    """declared AS MATERIALIZED (
  SELECT source, ref_id AS decl_id, min((target_source, target_id)) AS t FROM staged GROUP BY source, ref_id),
names AS (SELECT source, node_id AS ref_id, scope_id, name FROM g_nodes WHERE kind = 'NAME_REF'), """
    + _stages("names", "_n")
    + ", made AS (SELECT source, node_id AS ref_id, scope_id, type_name AS name FROM g_made WHERE kind = 'OBJECT_CREATION'), "
    + _stages("made", "_c")
    + """,
every_node AS MATERIALIZED (SELECT source, node_id, kind, name, receiver_id, scope_id FROM g_nodes UNION ALL SELECT source, node_id, kind, name, receiver_id, scope_id FROM g_made),
first_variable AS (SELECT source, ref_id, min(target_id) AS decl_id FROM variables GROUP BY source, ref_id),
round0 AS MATERIALIZED (
  SELECT v.source, v.ref_id AS node_id, d.t FROM first_variable v JOIN declared d ON d.source = v.source AND d.decl_id = v.decl_id
  UNION ALL SELECT source, ref_id, min((target_source, target_id)) FROM staged_n s
  WHERE NOT EXISTS (SELECT 1 FROM first_variable v WHERE v.source = s.source AND v.ref_id = s.ref_id) GROUP BY source, ref_id HAVING count(*) = 1
  UNION ALL SELECT source, ref_id, min((target_source, target_id)) FROM staged_c GROUP BY source, ref_id
  UNION ALL SELECT n.source, n.node_id, {'source': e.source, 'id': e.type_id} FROM g_made n JOIN enclosing e USING (source, scope_id) WHERE n.kind = 'THIS'),
members AS MATERIALIZED (
  SELECT t.source AS owner_source, t.decl_id AS owner_id, m.name, CASE m.kind WHEN 'METHOD' THEN 'METHOD_CALL' ELSE 'FIELD_ACCESS' END AS kind, m.decl_id AS member_id
  FROM g_decls t JOIN g_decls m ON m.source = t.source AND m.scope_id = t.body_scope_id WHERE t.kind = 'TYPE' AND m.kind IN ('FIELD', 'LOCAL', 'METHOD')),
owner1 AS MATERIALIZED (
  SELECT n.source, n.node_id, n.kind, n.name, r.t[1] AS owner_source, r.t[2] AS owner_id FROM every_node n JOIN round0 r ON r.source = n.source AND r.node_id = n.receiver_id
  UNION ALL SELECT n.source, n.node_id, n.kind, n.name, e.source, e.type_id FROM g_made n JOIN enclosing e USING (source, scope_id) WHERE n.kind = 'METHOD_CALL' AND n.receiver_id IS NULL),
hit1 AS MATERIALIZED (
  SELECT n.source, n.node_id, n.kind, m.owner_source, m.member_id FROM owner1 n JOIN members m USING (owner_source, owner_id, name, kind)),
round1 AS MATERIALIZED (
  SELECT h.source, h.node_id, d.t FROM (SELECT source, node_id, owner_source, min(member_id) AS member_id FROM hit1 GROUP BY ALL) h
  JOIN declared d ON d.source = h.owner_source AND d.decl_id = h.member_id),
owner2 AS MATERIALIZED (
  SELECT n.source, n.node_id, n.kind, n.name, r.t[1] AS owner_source, r.t[2] AS owner_id FROM every_node n JOIN round1 r ON r.source = n.source AND r.node_id = n.receiver_id),
hit2 AS MATERIALIZED (
  SELECT n.source, n.node_id, n.kind, m.owner_source, m.member_id FROM owner2 n JOIN members m USING (owner_source, owner_id, name, kind)),
round2 AS (
  SELECT h.source, h.node_id, d.t FROM (SELECT source, node_id, owner_source, min(member_id) AS member_id FROM hit2 GROUP BY ALL) h
  JOIN declared d ON d.source = h.owner_source AND d.decl_id = h.member_id)"""
).replace("r.t[1]", "r.t.source").replace("r.t[2]", "r.t.id")
_RECEIVERS = _RECEIVERS.replace("min((target_source, target_id))", "min({'source': target_source, 'id': target_id})")

_INDEX = """spans AS (
  SELECT source, start_at, end_at, 'DECLARATION' AS entity_kind, decl_id AS entity_id, 0 AS ord FROM g_decls
  UNION ALL SELECT source, name_start, name_start + strlen(name), 'DECLARATION', decl_id, 1 FROM g_decls WHERE name IS NOT NULL
  UNION ALL SELECT source, start_at, end_at, 'SCOPE', scope_id, 3 FROM g_scopes
  UNION ALL SELECT source, start_at, end_at, 'NODE', node_id, 5 FROM g_nodes
  UNION ALL SELECT source, name_start, name_start + strlen(name), 'NODE', node_id, 6 FROM g_nodes WHERE kind IN ('FIELD_ACCESS', 'METHOD_CALL')),
points AS (SELECT source, node_id AS request_id, end_at - 1 AS at FROM g_nodes)"""

_TIGHTEST = """tightest AS MATERIALIZED (
  SELECT source, request_id, e.* FROM (
    SELECT p.source, p.request_id, arg_min({'entity_kind': s.entity_kind, 'entity_id': s.entity_id, 'start_at': s.start_at, 'end_at': s.end_at},
      {'w': s.end_at - s.start_at, 'a': s.start_at, 'b': s.end_at, 'o': s.ord, 'i': s.entity_id}) AS e
    FROM points p JOIN spans s ON s.source = p.source AND p.at BETWEEN s.start_at AND s.end_at GROUP BY p.source, p.request_id))"""

_LABELS = """labels AS (
  SELECT d.source, d.decl_id, CASE WHEN d.kind = 'TYPE' THEN concat_ws('.', f.package, d.name) ELSE d.name END AS label
  FROM g_decls d LEFT JOIN g_files f USING (source))"""


def _graph(body: str, *ctes: str) -> str:
    names = ("g_files", "g_scopes", "g_decls", "g_imports", "g_nodes", "g_versions", "g_inner", "g_qrefs", "g_statics", "g_irefs", "g_locals", "g_supers", "g_bounds", "g_aliases", "g_made")
    text = " ".join((body, *ctes))
    views = re.sub(r"\b(li|g_\w+) AS \(", r"\1 AS MATERIALIZED (", prefix(*[n for n in names if n in text]))
    return "WITH RECURSIVE " + ", ".join((views, *ctes)) + " " + body


_OCCURRENCES = """found AS (
  SELECT h.*, d.name_start, d.name_start + strlen(d.name) AS name_end FROM (
    SELECT DISTINCT source, request_id, source AS target_source, entity_id AS target_id FROM tightest WHERE entity_kind = 'DECLARATION'
    UNION SELECT t.source, t.request_id, v.target_source, v.target_id FROM tightest t JOIN (
      SELECT source, ref_id, target_source, target_id FROM variables
      UNION SELECT source, node_id, owner_source, member_id FROM hit1 UNION SELECT source, node_id, owner_source, member_id FROM hit2) v
      ON t.entity_kind = 'NODE' AND v.source = t.source AND v.ref_id = t.entity_id
    UNION SELECT d.source, -d.decl_id, s.target_source, s.target_id FROM g_decls d JOIN staged s ON s.source = d.source AND s.ref_id = d.decl_id WHERE d.kind = 'FIELD' AND d.decl_id % 100 = 1) h
  JOIN g_decls d ON d.source = h.target_source AND d.decl_id = h.target_id AND d.name IS NOT NULL)"""

_ALL = (_CHAIN, _CANONICAL, _REFS, _stages(), _VARIABLES, _ENCLOSING, _RECEIVERS)
#: Lengths of fixed parts of the texts of x3: before the package, and from a body's brace to the inner type.
_HEAD, _SKIP = 72,98
_LINES = """ls AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
_POINTS = """pts AS (SELECT doc_id AS source, text, unnest(range(0, length(text) + 1, 200)) AS c FROM documents),
cut AS (SELECT source, c, text, left(text, c) AS before FROM pts)"""
_CLEAN = """known AS (SELECT *, coalesce(bool_or(NOT deleted) OVER (PARTITION BY key ORDER BY revision, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS k FROM g_versions),
puts AS (SELECT key, revision, seq, deleted, value FROM known WHERE NOT deleted OR k),
clean AS (SELECT key, revision, arg_max(seq, seq) AS seq, arg_max(deleted, seq) AS deleted, arg_max(row(value), seq)[1] AS value FROM puts GROUP BY key, revision)"""
_HEADS = """heads AS (SELECT key, h.revision AS revision, h.value AS value FROM (
  SELECT key, arg_max({'revision': revision, 'deleted': deleted, 'value': value}, {'r': revision, 's': seq}) AS h FROM g_versions WHERE revision <= %s GROUP BY key) WHERE NOT h.deleted)"""
_NOW = _HEADS % "9223372036854775807"

ORACLES = {
    "a1_scan_sources": """SELECT 'SOURCE_FILE' AS kind, '/src/' || source || '/D' || doc_id || CASE WHEN lang = 'en' THEN '.java' ELSE '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS n_bytes
      FROM documents WHERE text IS NOT NULL""",
    "a2_uri_to_path": "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN '/w a+b/' || source || '/D' || doc_id || '.java' END AS path FROM documents",
    "a3_path_to_uri": "SELECT doc_id, CASE WHEN lang NOT IN ('es', 'fr') THEN 'file:///w/x/D' || doc_id END AS uri FROM documents",
    "a4_accepts": "SELECT '/src/' || source || '/D' || doc_id || '.java' AS path FROM documents WHERE text IS NOT NULL AND lang = 'en'",
    "a5_in_search_scope": _graph("SELECT source, ord, name FROM g_imports WHERE source IN (SELECT source FROM g_files WHERE package IS NOT NULL)"),
    "a6_replace_contribution": _graph("""SELECT d.source, CASE WHEN f.package IS NULL THEN 'new.' || d.name ELSE f.package || '.' || d.name END AS fqn, 'CLASS' AS kind
      FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0"""),
    "a7_trace_rows": "SELECT 'in' AS dir, epoch_us(ts) // 1000 AS at, event_id, props FROM events",
    "v1_compact_same_revision": _graph("SELECT key, revision, arg_max(seq, seq) AS seq, arg_max(deleted, seq) AS deleted, arg_max(row(value), seq)[1] AS value FROM g_versions GROUP BY key, revision"),
    "v2_drop_noop_deletes": _graph("SELECT * FROM puts", _CLEAN.rsplit(",\nclean", 1)[0]).replace("FROM g_versions)", "FROM g_versions)"),
    "v3_latest": _graph("SELECT * FROM heads WHERE key IN (SELECT concat('u', user_id) FROM events WHERE event_type = 'purchase')", _NOW),
    "v4_heads": _graph("SELECT * FROM heads", _NOW),
    "v5_as_of_join": _graph("""SELECT p.key, p.at, (SELECT CASE WHEN c.deleted THEN NULL ELSE c.value END FROM clean c WHERE c.key = p.key AND c.revision <= p.at ORDER BY c.revision DESC LIMIT 1) AS value
      FROM (SELECT DISTINCT key, unnest(range(0, 801, 40)) AS at FROM g_versions) p""", _CLEAN),
    "v6_snapshot_at": _graph("SELECT * FROM heads", _HEADS % "300"),
    "v7_assign_revisions": "SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS revision FROM events",
    "v8_vacuum": _graph("""SELECT key, revision, seq, deleted, value FROM (SELECT *, lead(revision) OVER (PARTITION BY key ORDER BY revision) AS nxt FROM clean)
      WHERE (nxt IS NULL OR nxt > 300) AND NOT (deleted AND revision <= 300)""", _CLEAN),
    "v9_stale_index_rows": _graph("SELECT key, seq FROM g_versions WHERE NOT deleted AND key NOT IN (SELECT key FROM heads)", _NOW),
    "v10_changed_sources": "SELECT doc_id AS source, 'CHANGED' AS change FROM documents WHERE contains(text, ' the ')",
    "t1_line_table": f"WITH {_LINES} SELECT doc AS source, pos AS line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at, strlen(line)::BIGINT AS n_bytes FROM ls",
    "t2_offset_to_line_column": f"WITH {_POINTS} SELECT source, strlen(before)::BIGINT AS at, c, length(before) - length(replace(before, chr(10), '')) AS line, length(string_split(before, chr(10))[-1]) AS character FROM cut",
    "t3_span_to_line_columns": f"""WITH {_POINTS}, e AS (SELECT source, min(c) AS a, max(c) AS b, any_value(text) AS text FROM cut GROUP BY source), f AS (SELECT source, left(text, a) AS x, left(text, b) AS y FROM e)
      SELECT source, strlen(x)::BIGINT AS start_at, strlen(y)::BIGINT AS end_at, length(x) - length(replace(x, chr(10), '')) AS start_line, length(string_split(x, chr(10))[-1]) AS start_character,
        length(y) - length(replace(y, chr(10), '')) AS end_line, length(string_split(y, chr(10))[-1]) AS end_character FROM f""",
    "t4_line_column_to_offset": f"""WITH {_LINES}, l AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ls),
      q AS (SELECT doc AS source, pos AS line, unnest([0, 7, 40])::BIGINT AS character, line AS t, s FROM l)
      SELECT source, line, character, CASE WHEN length(t) >= character THEN s + strlen(left(t, character)) END AS at FROM q""",
    "t5_span_text": f"WITH {_POINTS}, e AS (SELECT source, max(c) AS b, any_value(text) AS text FROM cut GROUP BY source) SELECT source, 0::BIGINT AS start_at, strlen(left(text, b))::BIGINT AS end_at, md5(left(text, b)) AS md5 FROM e",
    "n1_package_and_simple_name": _graph("SELECT source, ord, left(name, length(name) - length(regexp_extract(name, '[^.]*$')) - 1) AS package, 'Inner' AS simple FROM g_imports"),
    "n2_segments": _graph("SELECT source, ord, len(string_split(name || '$Inner', '.')) AS n, array_to_string(list_reverse(string_split(name || '$Inner', '.')), '.') AS backwards FROM g_imports"),
    "n3_strip_package": _graph("""SELECT i.source, ord, CASE WHEN f.package IS NULL THEN i.name WHEN starts_with(i.name, f.package || '.') THEN substr(i.name, length(f.package) + 2) END AS rest
      FROM g_imports i JOIN g_files f USING (source)"""),
    "n4_same_package": _graph("SELECT package, count(*) AS n, count(*) AS m FROM g_files GROUP BY package"),
    "n5_project_classes": _graph("SELECT d.source, concat_ws('.', f.package, d.name) AS fqn, 'CLASS' AS kind FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0"),
    "n6_lookup_class": _graph("SELECT canonical AS fqn, 'CLASS' AS kind, min(source) AS source FROM canonical WHERE canonical IN (SELECT name FROM g_imports) GROUP BY canonical", _CANONICAL),
    "n7_classes_in_package": _graph("""SELECT d.source, concat_ws('.', f.package, d.name) AS fqn, f.package FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0
      AND f.package IN (SELECT regexp_extract(name, '^(.*)\\.[^.]*$', 1) FROM g_imports WHERE kind = 'STATIC')"""),
    "n8_canonical_types": _graph("SELECT source, decl_id, canonical FROM canonical", _CANONICAL),
    "x1_extract_package": _graph("SELECT source, package FROM g_files"),
    "x2_extract_imports": _graph("SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS ord, name, kind FROM g_imports"),
    "x3_extract_types": _graph("""SELECT source, name, 'class' AS kind, type_name AS superclass, 1::BIGINT AS depth, h AS header_at, h + 6 AS name_at, b AS body_at, b + {skip} + 31 AS body_end, NULL::BIGINT AS enclosing_at FROM placed
      UNION ALL SELECT source, 'In', 'interface', NULL, 2, b + {skip}, b + {skip} + 10, b + {skip} + 13, b + {skip} + 29, h FROM placed""".format(skip=_SKIP),
      """lead AS (SELECT f.source, {head} + coalesce(length(f.package) + 10, 0) + coalesce(sum(length(i.name) + CASE i.kind WHEN 'STATIC' THEN 15 WHEN 'TYPE_ON_DEMAND' THEN 10 ELSE 8 END + 1), 1) AS n
        FROM g_files f LEFT JOIN g_imports i USING (source) GROUP BY f.source, f.package),
      ty AS (SELECT d.source, d.decl_id, d.name, d.type_name, length(d.name) + coalesce(length(d.type_name) + 9, 0) AS w FROM g_decls d WHERE kind = 'TYPE'),
      placed AS (SELECT source, name, type_name, h, h + 6 + w + 1 AS b FROM (SELECT ty.*, (lead.n + 16 + coalesce(sum(22 + w + 1 + {skip} + 30 + 3 + 1) OVER (PARTITION BY source ORDER BY decl_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS h FROM ty JOIN lead USING (source)))
      """.format(head=_HEAD, skip=_SKIP)),
    "x4_nest_tokens": r"""WITH RECURSIVE parts AS (
        SELECT page_id AS source, unnest(regexp_extract_all(html, '(?s)(.*?)(</?(?:nav|ul|article)[^>]*>)')) AS part, generate_subscripts(regexp_extract_all(html, '(?s)(.*?)(</?(?:nav|ul|article)[^>]*>)'), 1) AS n FROM pages),
      toks AS (SELECT source, sum(length(part)) OVER (PARTITION BY source ORDER BY n) - length(regexp_extract(part, '(</?(?:nav|ul|article)[^>]*>)$', 1)) AS p,
        CASE WHEN regexp_matches(part, '</(?:nav|ul|article)[^>]*>$') THEN -1 ELSE 1 END AS step FROM parts),
      d AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY p) + CASE step WHEN -1 THEN 1 ELSE 0 END AS depth FROM toks),
      iv AS (SELECT source, p AS start_at, lead(p) OVER (PARTITION BY source, depth ORDER BY p) AS end_at, depth, step FROM d),
      ok AS (SELECT source, start_at, end_at, depth FROM iv WHERE step = 1 AND end_at IS NOT NULL)
      SELECT a.source, a.start_at::BIGINT AS start_at, a.end_at::BIGINT AS end_at, a.depth::BIGINT AS depth,
        (SELECT max(b.start_at) FROM ok b WHERE b.source = a.source AND b.depth = a.depth - 1 AND b.start_at < a.start_at)::BIGINT AS parent_at FROM ok a""",
    "p1_position_index": _graph("SELECT source, entity_kind, ord, count(*) AS n, sum(end_at - start_at)::BIGINT AS width FROM spans GROUP BY ALL", _INDEX),
    "p2_containing": _graph("SELECT p.source, p.request_id, count(*) AS n, sum(s.end_at - s.start_at)::BIGINT AS width FROM points p JOIN spans s ON s.source = p.source AND p.at BETWEEN s.start_at AND s.end_at GROUP BY ALL", _INDEX),
    "p3_tightest_containing": _graph("SELECT * FROM tightest", _INDEX, _TIGHTEST),
    "s1_scope_chain": _graph("SELECT source, scope_id, ancestor_id, distance FROM chain", _CHAIN),
    "s2_declaration_chain": _graph("SELECT c.source, c.scope_id, c.distance, count(*) AS n, sum(d.decl_id)::BIGINT AS ids FROM chain c JOIN g_decls d ON d.source = c.source AND d.scope_id = c.ancestor_id GROUP BY ALL", _CHAIN),
    "s3_enclosing_type": _graph("SELECT source, scope_id, type_id FROM enclosing", _CHAIN, _ENCLOSING),
    "s4_declaration_label": _graph("SELECT * FROM labels", _LABELS),
    "s5_label_at": _graph("SELECT source, name_start, arg_min(label, decl_id) AS label FROM g_decls JOIN labels USING (source, decl_id) GROUP BY ALL", _LABELS),
    "s6_declaration_facts": _graph("""SELECT source, decl_id, kind, name, CASE kind WHEN 'TYPE' THEN 'TYPE' WHEN 'METHOD' THEN 'METHOD' ELSE 'VARIABLE' END AS namespace, scope_id, type_name,
      start_at, end_at, name_start, name_start + strlen(name) AS name_end FROM g_decls"""),
    "s6_declarations_by_id": _graph("""SELECT o.request_id, o.pos, d.decl_id, d.name, d.name_start, d.name_start + strlen(d.name) AS name_end FROM (
        SELECT o_orderkey AS request_id, 'c' || o_custkey AS source, unnest([0, 1, 2, 3, 4])::BIGINT AS pos, o_orderkey * 1000 + unnest([102, 0, 101, 99, 0]) AS id FROM orders) o
      JOIN g_decls d ON d.source = o.source AND d.decl_id = o.id"""),
    "r1_resolve_lexical": _graph("SELECT * FROM lexical", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r2_resolve_exact_imports": _graph("SELECT * FROM exact", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r3_resolve_same_package": _graph("SELECT source, ref_id, count(*) AS n, sum(target_id)::BIGINT AS ids FROM package GROUP BY ALL", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r4_classify": _graph("""SELECT r.source, r.ref_id, count(e.target_id) AS targets, CASE count(e.target_id) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS result
      FROM refs r LEFT JOIN exact e ON e.source = r.source AND e.ref_id = r.ref_id GROUP BY r.source, r.ref_id""", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r5_resolve_type_names": _graph("""SELECT r.source, r.ref_id, count(e.target_id) AS targets, CASE count(e.target_id) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS result, min(e.stage) AS stage
      FROM refs r LEFT JOIN staged e ON e.source = r.source AND e.ref_id = r.ref_id GROUP BY r.source, r.ref_id""", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r6_find_members": _graph("""SELECT t.source AS owner_source, t.decl_id AS owner_id, m.name, m.decl_id AS member_id FROM g_decls t JOIN g_decls m ON m.source = t.source AND m.scope_id = t.body_scope_id
      WHERE t.kind = 'TYPE' AND m.kind IN ('FIELD', 'LOCAL')"""),
    "r7_resolve_variables": _graph("SELECT * FROM variables", _CHAIN, _VARIABLES),
    "r8_resolve_type_refs": _graph("SELECT source, ref_id, count(*) AS n, sum(target_id)::BIGINT AS ids FROM staged GROUP BY ALL", _CHAIN, _CANONICAL, _REFS, _stages()),
    "r9_receiver_class": _graph("SELECT source, node_id, t.source AS class_source, t.id AS class_id FROM (SELECT * FROM round0 UNION ALL SELECT * FROM round1 UNION ALL SELECT * FROM round2)", *_ALL),
    "r10_resolve_expressions": _graph("""SELECT source, ref_id, target_source, target_id FROM variables UNION SELECT source, node_id, owner_source, member_id FROM hit1
      UNION SELECT source, node_id, owner_source, member_id FROM hit2 UNION SELECT source, ref_id, target_source, target_id FROM staged_c
      UNION SELECT n.source, n.node_id, e.source, e.type_id FROM g_made n JOIN enclosing e USING (source, scope_id) WHERE n.kind = 'THIS'""", *_ALL),
    "r6_inherited_members": _graph("""SELECT DISTINCT source AS owner_source, id AS owner_id, name, ts AS target_source, member AS member_id, d AS steps FROM (
        SELECT u.*, m.name, m.member, min(u.d) OVER (PARTITION BY u.source, u.id, m.name) AS least FROM up u JOIN own m ON m.source = u.ts AND m.id = u.tid) WHERE d = least""",
      """own AS MATERIALIZED (SELECT t.source, t.decl_id AS id, m.name, m.decl_id AS member FROM g_decls t JOIN g_decls m ON m.source = t.source AND m.scope_id = t.body_scope_id WHERE t.kind = 'TYPE' AND m.kind IN ('FIELD', 'LOCAL')),
      up(source, id, ts, tid, d) AS (SELECT source, decl_id, source, decl_id, 0 FROM g_decls WHERE kind = 'TYPE' UNION SELECT u.source, u.id, e.super_source, e.super_id, u.d + 1 FROM up u JOIN g_supers e ON e.source = u.ts AND e.decl_id = u.tid)"""),
    "r11_resolve_occurrences": _graph("SELECT * FROM found", *_ALL, _INDEX, _TIGHTEST, _OCCURRENCES),
    "r13_hover": _graph("""SELECT request_id, 'Java declaration' || coalesce(': ' || label, '') AS text, t.name_start AS name_start, t.name_end AS name_end FROM (
      SELECT request_id, source, arg_min({'i': target_id, 'name_start': name_start, 'name_end': name_end}, {'a': name_start, 'b': target_id}) AS t FROM found WHERE source = target_source GROUP BY ALL) f
      LEFT JOIN labels l ON l.source = f.source AND l.decl_id = t.i""", *_ALL, _INDEX, _TIGHTEST, _OCCURRENCES, _LABELS),
    "d1_without_static_imports": _graph("SELECT * FROM g_files WHERE source NOT IN (SELECT source FROM g_imports WHERE kind = 'STATIC')"),
    "d2_without_superclass": _graph("SELECT source, scope_id FROM g_scopes EXCEPT SELECT source, scope_id FROM heirs", _CHAIN, """heirs AS (
      SELECT c.source, c.scope_id FROM chain c JOIN g_scopes s ON s.source = c.source AND s.scope_id = c.ancestor_id
      JOIN g_decls d ON d.source = s.source AND d.decl_id = s.owner_id WHERE d.kind = 'TYPE' AND d.type_name IS NOT NULL)"""),
    "d3_without_receivers": _graph("SELECT source, node_id, name FROM g_nodes n WHERE kind = 'NAME_REF' AND NOT EXISTS (SELECT 1 FROM g_nodes m WHERE m.source = n.source AND m.receiver_id = n.node_id)"),
}
_UNRESOLVED = """quiet AS (SELECT source FROM g_imports WHERE kind = 'STATIC'),
heirs AS (SELECT c.source, c.scope_id FROM chain c JOIN g_scopes s ON s.source = c.source AND s.scope_id = c.ancestor_id
  JOIN g_decls d ON d.source = s.source AND d.decl_id = s.owner_id WHERE d.kind = 'TYPE' AND d.type_name IS NOT NULL),
missing AS (SELECT n.* FROM g_nodes n WHERE n.kind = 'NAME_REF' AND n.source NOT IN (SELECT source FROM quiet)
  AND NOT EXISTS (SELECT 1 FROM heirs h WHERE h.source = n.source AND h.scope_id = n.scope_id)
  AND NOT EXISTS (SELECT 1 FROM g_nodes m WHERE m.source = n.source AND m.receiver_id = n.node_id)
  AND NOT EXISTS (SELECT 1 FROM variables v WHERE v.source = n.source AND v.ref_id = n.node_id))"""
_WIDE = """opened AS (SELECT DISTINCT source, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS parent FROM g_imports WHERE kind = 'TYPE_ON_DEMAND'),
wide AS (SELECT DISTINCT r.source, r.ref_id, k.source AS target_source, k.decl_id AS target_id FROM refs r JOIN opened o ON o.source = r.source
  JOIN canonical k ON contains(k.canonical, '.') AND regexp_extract(k.canonical, '^(.*)\\.[^.]*$', 1) = o.parent AND regexp_extract(k.canonical, '[^.]*$') = r.name)"""
ORACLES |= {
    "d4_unresolved_names": _graph("SELECT source, node_id, start_at, end_at, 'ERROR' AS severity, 'cannot-find-symbol' AS code, 'cannot find symbol: ' || name AS message FROM missing", _CHAIN, _VARIABLES, _UNRESOLVED),
    "m1_slice_body": f"""WITH {_LINES}, e AS (SELECT doc, min(pos) FILTER (starts_with(line, 'T')) AS a, min(pos) FILTER (starts_with(line, 'On')) AS b FROM ls GROUP BY doc)
      SELECT doc, pos, md5(line) AS md5 FROM ls JOIN e USING (doc) WHERE pos >= a AND (b IS NULL OR pos < b)""",
    "m2_clean_lines": r"""WITH p AS (SELECT page_id AS doc, unnest(string_split(html, '<p>')) AS line, generate_subscripts(string_split(html, '<p>'), 1) - 1 AS pos FROM pages),
      a AS (SELECT doc, pos, regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(regexp_replace(line, '^\s*<div[^>]*>', '', 'g'), '</div>', ''), '<span[^>]*>', '', 'g'), '</span>', ''), '<em>', ''), '</em>|\s*®', '', 'g'),
        ' accesskey="[^"]*"', '', 'g') AS line FROM p)
      SELECT doc, pos, md5(regexp_replace(replace(line, '**Table of Contents**', '## Contents'), '<a href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g')) AS md5 FROM a""",
    "m3_rewrite_links": "SELECT page_id AS doc, 0::BIGINT AS pos, url || ' ch06-names.md#x #y ch07-packages-modules.md' AS line FROM pages",
    "m4_collapse_blanks": f"""WITH {_LINES}, b AS (SELECT doc, pos, length(line) < 60 AS e FROM ls),
      c AS (SELECT *, lag(e, 1, false) OVER w AS e1, lag(e, 2, false) OVER w AS e2 FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos))
      SELECT doc, count(*) AS n, sum(pos)::BIGINT AS positions FROM c WHERE NOT (e AND e1 AND e2) GROUP BY doc""",
    "m5_assemble": "SELECT conv_id AS doc, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10)) AS md5, count(*) AS n_lines FROM conversations GROUP BY conv_id",
    "m6_toc": "SELECT conv_id, string_agg(printf('%d. [%s](ch%02d-%s.md)', turn::INT, role, turn::INT, lower(role)) || chr(10), '' ORDER BY turn) AS toc FROM conversations GROUP BY conv_id",
    "b1_resolve_on_demand": _graph("SELECT * FROM wide", _CANONICAL, _REFS, _WIDE),
    "b3_four_stages": _graph("""SELECT source, ref_id, stage, count(*) AS n, sum(target_id)::BIGINT AS ids FROM (SELECT * FROM staged
      UNION ALL SELECT *, 4 FROM wide w WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source = w.source AND s.ref_id = w.ref_id)) GROUP BY ALL""", _CHAIN, _CANONICAL, _REFS, _stages(), _WIDE),
    "b5_inherited_members": _graph("""SELECT DISTINCT c.type, m.name, m.member FROM closure c JOIN mem m ON m.type = c.super
      WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.type = c.type AND o.name = m.name)""",
      "ty AS (SELECT source, decl_id, name, body_scope_id FROM g_decls WHERE kind = 'TYPE')",
      "fst AS (SELECT source, name, min(decl_id) AS super FROM ty GROUP BY source, name)",
      "direct AS (SELECT DISTINCT t.decl_id AS type, f.super FROM ty t JOIN g_decls d ON d.source = t.source AND d.scope_id = t.body_scope_id AND d.kind = 'FIELD' JOIN fst f ON f.source = t.source AND f.name = d.type_name WHERE t.decl_id <> f.super)",
      "closure(type, super) AS (SELECT type, super FROM direct UNION SELECT c.type, d.super FROM closure c JOIN direct d ON d.type = c.super)",
      "mem AS (SELECT t.decl_id AS type, d.name, d.decl_id AS member FROM ty t JOIN g_decls d ON d.source = t.source AND d.scope_id = t.body_scope_id AND d.kind = 'METHOD')"),
    "b7_import_collisions": _graph("SELECT source, regexp_extract(name, '[^.]*$') AS simple, count(DISTINCT name) AS names FROM g_imports WHERE kind = 'TYPE' GROUP BY ALL HAVING count(DISTINCT name) > 1"),
    "b7_unresolvable_imports": _graph("SELECT source, ord, name FROM g_imports WHERE kind = 'TYPE' AND name NOT IN (SELECT canonical FROM canonical)", _CANONICAL),
    "b8_unresolvable_types": _graph("SELECT source, ref_id, name FROM refs r WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source = r.source AND s.ref_id = r.ref_id)", _CHAIN, _CANONICAL, _REFS, _stages()),
    "b9_import_suggestions": _graph("""SELECT name, count(*) AS n, md5(string_agg(canonical, ',' ORDER BY canonical)) AS md5 FROM (
      SELECT DISTINCT regexp_extract(canonical, '[^.]*$') AS name, canonical FROM canonical) WHERE name IN (
      SELECT name FROM refs r WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source = r.source AND s.ref_id = r.ref_id)) GROUP BY name""", _CHAIN, _CANONICAL, _REFS, _stages()),
    "st1_edit_stream": "SELECT concat('u', user_id) AS source, event_id AS revision, props AS contents FROM events WHERE event_type <> 'error'",
    "st2_heads_stream": "SELECT concat('u', user_id) AS source, max(event_id) AS revision, arg_max(props, event_id) AS contents FROM events WHERE event_type <> 'error' GROUP BY ALL",
}

_CLASSES = """cl AS (SELECT '/src/c' || o_custkey || '.java' AS source, o_orderkey AS node_id, 'T' || (o_orderkey % 40) AS name, 'T' || ((o_orderkey + o_custkey) % 40) AS base,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line FROM orders)"""
_INNER = """inner_first AS MATERIALIZED (SELECT source, outer_id, name, min(decl_id) AS decl_id FROM g_inner GROUP BY ALL),
inner_canon AS MATERIALIZED (SELECT f.source, f.decl_id, k.canonical || '.' || f.name AS canonical, k.canonical AS outer_name, f.name FROM inner_first f JOIN canonical k ON k.source = f.source AND k.decl_id = f.outer_id),
st AS MATERIALIZED (SELECT k.* FROM inner_canon k JOIN g_inner i USING (source, decl_id) WHERE i.is_static)"""
_QUALIFIED = """qhead AS MATERIALIZED (SELECT q.source, q.ref_id, count(*) AS c, min(d.decl_id) AS id FROM g_qrefs q JOIN g_decls d ON d.source = q.source AND d.kind = 'TYPE' AND d.name = split_part(q.name, '.', 1) GROUP BY ALL),
qualified AS MATERIALIZED (
  SELECT h.source, h.ref_id, h.source AS target_source, f.decl_id AS target_id FROM qhead h JOIN g_qrefs q USING (source, ref_id)
  JOIN inner_first f ON f.source = h.source AND f.outer_id = h.id AND f.name = split_part(q.name, '.', 2) WHERE h.c = 1
  UNION ALL SELECT q.source, q.ref_id, k.source, k.decl_id FROM g_qrefs q JOIN inner_canon k ON k.canonical = q.name
  WHERE NOT EXISTS (SELECT 1 FROM qhead h WHERE h.source = q.source AND h.ref_id = q.ref_id))"""
_MODULES = """needs AS (SELECT DISTINCT c_custkey % 10 AS m, (c_custkey + 1) % 10 AS n, c_custkey % 2 = 0 AS t FROM customer),
further(a, b) AS (SELECT m, n FROM needs WHERE t UNION SELECT f.a, x.n FROM further f JOIN needs x ON x.m = f.b AND x.t),
readable AS (SELECT m AS a, n AS b FROM needs UNION SELECT x.m, f.b FROM needs x JOIN further f ON f.a = x.n UNION SELECT m, m FROM needs UNION SELECT n, n FROM needs),
asks AS (SELECT 'c' || c_custkey AS source, c_custkey % 10 AS own, (c_custkey // 10) % 10 AS m FROM customer)"""
_LOCAL_HITS = """near AS MATERIALIZED (SELECT r.source, r.ref_id, l.decl_id AS target_id, l.kind FROM g_irefs r JOIN g_locals l ON l.source = r.source AND l.scope_id = r.scope_id AND l.name = r.name
  WHERE NOT l.is_local OR l.start_at <= r.at)"""
ORACLES |= {
    "d5_publish_rows": f"""WITH {_CLASSES} SELECT source, node_id, 1 AS level, 'java' AS tag, 'cannot-find-symbol' AS code, 'cannot find symbol: ' || base AS message, 1 AS version,
      line AS start_line, length(name) + 15 AS start_character, line AS end_line, length(name) + 15 + length(base) AS end_character
      FROM cl a WHERE NOT EXISTS (SELECT 1 FROM cl b WHERE b.source = a.source AND b.name = a.base)""",
    "r12_goto_locations": f"""WITH {_CLASSES} SELECT a.node_id AS request_id, CASE WHEN b.line IS NOT NULL THEN 'file://' || a.source END AS uri, b.line AS start_line, CASE WHEN b.line IS NOT NULL THEN 6 END AS start_character,
      b.line AS end_line, 6 + length(b.name) AS end_character FROM cl a LEFT JOIN cl b ON b.source = a.source AND b.name = a.base AND a.node_id % 7 <> 0""",
    "b2_static_imports": _graph("""SELECT r.source, r.ref_id, count(*) AS n, sum(b.decl_id)::BIGINT AS ids FROM g_irefs r JOIN (SELECT * FROM one UNION SELECT * FROM wide) b ON b.source = r.source AND b.name = r.name GROUP BY ALL""",
      _CANONICAL, _INNER, """one AS MATERIALIZED (SELECT DISTINCT s.source, k.name, k.source AS ts, k.decl_id FROM g_statics s JOIN st k ON s.kind = 'STATIC' AND k.canonical = s.name)""",
      """wide AS MATERIALIZED (SELECT DISTINCT s.source, k.name, k.source AS ts, k.decl_id FROM g_statics s JOIN st k ON s.kind = 'STATIC_ON_DEMAND' AND k.outer_name = s.name
        WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.source = s.source AND o.name = k.name))"""),
    "b4_qualified_names": _graph("SELECT * FROM qualified", _CANONICAL, _INNER, _QUALIFIED),
    "b6_inaccessible_types": _graph("""SELECT q.source, q.ref_id, q.target_source, q.target_id FROM qualified q JOIN g_inner i ON i.source = q.target_source AND i.decl_id = q.target_id
      JOIN g_qrefs r ON r.source = q.source AND r.ref_id = q.ref_id JOIN g_files h ON h.source = q.source JOIN g_files t ON t.source = q.target_source
      WHERE (i.access IN ('PACKAGE', 'PRIVATE') OR (i.outer_id // 1000) % 3 = 0) AND h.package IS DISTINCT FROM t.package
        OR i.access = 'PRIVATE' AND NOT (q.source = q.target_source AND i.outer_id = (r.scope_id // 100) * 1000)
        OR i.access = 'PROTECTED' AND h.package IS DISTINCT FROM t.package AND NOT EXISTS (SELECT 1 FROM kin k WHERE k.decl_id = (r.scope_id // 100) * 1000 AND k.super_id = i.outer_id)""",
      _CANONICAL, _INNER, _QUALIFIED, "kin(decl_id, super_id) AS (SELECT decl_id, super_id FROM g_supers UNION SELECT k.decl_id, e.super_id FROM kin k JOIN g_supers e ON e.decl_id = k.super_id)"),
    "b7_inaccessible_imports": _graph("""SELECT DISTINCT s.source, s.ord AS ref_id, k.source AS target_source, k.decl_id AS target_id FROM g_statics s JOIN inner_canon k ON k.canonical = s.name AND s.kind = 'STATIC'
      JOIN g_inner i ON i.source = k.source AND i.decl_id = k.decl_id JOIN g_files h ON h.source = s.source JOIN g_files t ON t.source = k.source
      WHERE (i.access <> 'PUBLIC' OR (i.outer_id // 1000) % 3 = 0) AND h.package IS DISTINCT FROM t.package OR i.access = 'PRIVATE'""", _CANONICAL, _INNER),
    "b7_invalid_static_imports": _graph("""SELECT s.source, s.ord, s.name FROM g_statics s WHERE s.kind = 'STATIC'
      AND EXISTS (SELECT 1 FROM canonical k WHERE k.canonical = regexp_extract(s.name, '^(.*)\\.[^.]*$', 1)) AND NOT EXISTS (SELECT 1 FROM st k WHERE k.canonical = s.name)""", _CANONICAL, _INNER),
    "b10_module_imports": _graph("""SELECT u.source, u.name, count(*) AS n, sum(k.decl_id)::BIGINT AS ids FROM (SELECT DISTINCT source, name FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source = r.source AND s.ref_id = r.ref_id)) u
      JOIN (SELECT DISTINCT a.source, x.p FROM asks a JOIN readable o ON o.a = a.own AND o.b = a.m JOIN readable r ON r.a = a.m
        JOIN (SELECT DISTINCT c_custkey % 10 AS m, 'p.n' || c_nationkey || '.s' || (c_custkey % 20) AS p FROM customer WHERE c_nationkey % 5 <> 0 AND c_nationkey % 7 = 0) x ON x.m = r.b) e ON e.source = u.source
      JOIN canonical k ON k.canonical = e.p || '.' || u.name GROUP BY ALL""", _CHAIN, _CANONICAL, _REFS, _stages(), _MODULES),
    "b10_unread_modules": f"WITH RECURSIVE {_MODULES} SELECT source, 'm' || m AS module FROM asks a WHERE NOT EXISTS (SELECT 1 FROM readable r WHERE r.a = a.own AND r.b = a.m)",
    "b11_illegal_type_parameter_uses": _graph("""SELECT source, ref_id, name FROM g_irefs r WHERE in_static
      AND EXISTS (SELECT 1 FROM near x WHERE x.source = r.source AND x.ref_id = r.ref_id AND x.kind = 'TYPE_PARAM')""", _LOCAL_HITS),
    "b12_local_types": _graph("""SELECT source, ref_id, source AS target_source, target_id FROM near
      UNION ALL SELECT r.source, r.ref_id, r.source, i.decl_id FROM g_irefs r JOIN g_inner i ON i.source = r.source AND i.scope_id = (r.scope_id // 100) * 100 + 1 AND i.name = r.name
      WHERE NOT EXISTS (SELECT 1 FROM near x WHERE x.source = r.source AND x.ref_id = r.ref_id)""", _LOCAL_HITS),
    "a6_bucketed_replacement": _graph("""SELECT d.source, CASE WHEN f.package IS NULL THEN 'new.' || d.name ELSE f.package || '.' || d.name END AS fqn, 'CLASS' AS kind
      FROM g_decls d JOIN g_files f USING (source) WHERE d.kind = 'TYPE' AND d.scope_id = 0 AND d.source NOT LIKE '%7'"""),
    "st3_diagnostics_stream": """WITH e AS (SELECT 'c' || o_custkey AS source, arg_max(o_orderkey, o_orderkey) AS last, max(o_orderkey) FILTER (o_orderkey % 11 <> 0) AS k, any_value(o_custkey) AS c FROM orders GROUP BY o_custkey),
      t AS (SELECT source, last % 11 = 0 AS closed, 'T' || (k % 97) AS name, 'T' || ((k * 7 + c) % 131) AS base FROM e),
      m AS (SELECT *, NOT closed AND base IS NOT NULL AND base NOT IN (SELECT name FROM t WHERE name IS NOT NULL) AS bad FROM t)
      SELECT source, CASE WHEN NOT closed THEN 1 END AS version, CASE WHEN bad THEN length(name) + 15 END::BIGINT AS start_at, CASE WHEN bad THEN length(name) + 15 + length(base) END::BIGINT AS end_at,
        CASE WHEN bad THEN 'cannot-find-symbol' END AS code, CASE WHEN bad THEN 'cannot find symbol: ' || base END AS message FROM m""",
    "st4_batch_barrier": """WITH b AS (SELECT min(event_id) AS low, max(event_id) + 1 AS high FROM events),
      cuts AS (SELECT (SELECT max(event_id) FROM events WHERE event_type <> 'error' AND event_id < low + (high - low) * k // 3) AS as_of FROM b, (SELECT unnest([1, 2, 3]) AS k))
      SELECT concat('u', user_id) AS source, max(event_id) AS revision, arg_max(props, event_id) AS contents, as_of FROM events JOIN cuts ON event_id <= as_of WHERE event_type <> 'error' GROUP BY user_id, as_of""",
    "st5_late_stream": _graph("""SELECT key, revision, seq, coalesce(revision < max(revision) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM g_versions"""),
    "st5_late_policy": _graph("""SELECT key, revision, seq, coalesce(revision < max(revision) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM g_versions"""),
}

_INHERITED = """mem AS MATERIALIZED (SELECT f.source, f.outer_id, f.name, f.decl_id, i.access, i.is_static, coalesce(g.package, chr(0)) AS home
  FROM (SELECT source, outer_id, name, min(decl_id) AS decl_id FROM g_inner GROUP BY ALL) f JOIN g_inner i USING (source, decl_id) JOIN g_files g USING (source)),
edges AS MATERIALIZED (SELECT e.*, coalesce(g.package, chr(0)) AS here FROM g_supers e JOIN g_files g USING (source)),
inh(source, type_id, name, target_source, target_id, access, home) AS (
  SELECT DISTINCT e.source, e.decl_id, m.name, m.source, m.decl_id, m.access, m.home FROM edges e JOIN mem m ON m.source = e.super_source AND m.outer_id = e.super_id
  WHERE m.access <> 'PRIVATE' AND (m.access <> 'PACKAGE' OR m.home = e.here) AND NOT EXISTS (SELECT 1 FROM mem o WHERE o.source = e.source AND o.outer_id = e.decl_id AND o.name = m.name)
  UNION SELECT e.source, e.decl_id, i.name, i.target_source, i.target_id, i.access, i.home FROM inh i JOIN edges e ON e.super_source = i.source AND e.super_id = i.type_id
  WHERE (i.access <> 'PACKAGE' OR i.home = e.here) AND NOT EXISTS (SELECT 1 FROM mem o WHERE o.source = e.source AND o.outer_id = e.decl_id AND o.name = i.name))"""
_HELD = """held AS MATERIALIZED (
  SELECT *, regexp_extract(full_name, '^(.*)\\.[^.]*$', 1) AS parent, regexp_extract(full_name, '[^.]*$') AS name FROM (
    SELECT k.canonical AS full_name, k.source AS target_source, k.decl_id AS target_id, true AS own, true AS is_static, CASE WHEN (k.decl_id // 1000) % 3 = 0 THEN 'PACKAGE' ELSE 'PUBLIC' END AS access, coalesce(g.package, chr(0)) AS home
    FROM canonical k JOIN g_files g USING (source)
    UNION ALL SELECT k.canonical, k.source, k.decl_id, true, m.is_static, m.access, m.home FROM inner_canon k JOIN mem m USING (source, decl_id)
    UNION ALL SELECT k.canonical || '.' || i.name, i.target_source, i.target_id, false, m.is_static, m.access, m.home FROM inh i JOIN canonical k ON k.source = i.source AND k.decl_id = i.type_id
      JOIN mem m ON m.source = i.target_source AND m.decl_id = i.target_id)),
asks AS MATERIALIZED (
  SELECT source, ord, CASE kind WHEN 'TYPE_ON_DEMAND' THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS name, kind FROM g_imports WHERE kind <> 'STATIC'
  UNION ALL SELECT source, ord + 30, name, kind FROM g_statics UNION ALL SELECT source, ord, name, kind FROM g_aliases),
met AS MATERIALIZED (SELECT a.source, a.ord, a.kind, h.*, h.access = 'PUBLIC' OR h.home = coalesce(f.package, chr(0)) AS seen
  FROM asks a JOIN held h ON a.kind IN ('TYPE', 'STATIC') AND h.full_name = a.name AND contains(a.name, '.') AND (h.own OR a.kind = 'STATIC') JOIN g_files f ON f.source = a.source)"""
_STRANGE = """strange AS MATERIALIZED (SELECT DISTINCT a.source, a.ord, a.name, h.target_source, h.target_id FROM asks a JOIN held h ON h.full_name = a.name AND NOT h.own
  WHERE a.kind IN ('TYPE', 'TYPE_ON_DEMAND') AND NOT EXISTS (SELECT 1 FROM held o WHERE o.own AND o.full_name = a.name))"""
_BEHIND = """par AS (SELECT source, decl_id FROM g_locals WHERE kind = 'TYPE_PARAM'),
reach(source, decl_id, bound_id) AS (SELECT source, decl_id, bound_id FROM g_bounds UNION SELECT r.source, r.decl_id, b.bound_id FROM reach r JOIN g_bounds b ON b.source = r.source AND b.decl_id = r.bound_id),
behind AS MATERIALIZED (SELECT * FROM reach r WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.source = r.source AND p.decl_id = r.bound_id))"""
_EVERY = "every AS MATERIALIZED (SELECT source, outer_id, name, source AS ts, decl_id AS ti FROM mem UNION SELECT source, type_id, name, target_source, target_id FROM inh)"
ORACLES |= {
    "b5_inherited_member_types": _graph("SELECT source, type_id, name, target_source, target_id FROM inh", _INHERITED),
    "b7_non_canonical_imports": _graph("SELECT * FROM strange", _CANONICAL, _INNER, _INHERITED, _HELD, _STRANGE),
    "b7_import_checks": _graph("""SELECT source, ord, code FROM (SELECT a.source, a.ord, CASE WHEN EXISTS (SELECT 1 FROM strange x WHERE x.source = a.source AND x.ord = a.ord) THEN 'non-canonical-import'
          WHEN v.seen IS NULL THEN 'unresolvable-import' WHEN NOT v.seen THEN 'inaccessible-import' WHEN NOT v.good THEN 'invalid-static-import' END AS code
        FROM asks a LEFT JOIN (SELECT source, ord, bool_or(seen) AS seen, bool_or(seen AND (kind = 'TYPE' OR is_static)) AS good FROM met GROUP BY ALL) v ON v.source = a.source AND v.ord = a.ord WHERE a.kind IN ('TYPE', 'STATIC')) WHERE code IS NOT NULL
      UNION ALL SELECT DISTINCT x.source, x.ord, 'non-canonical-import' FROM strange x JOIN asks a ON a.source = x.source AND a.ord = x.ord AND a.kind = 'TYPE_ON_DEMAND'
      UNION ALL SELECT DISTINCT f.source, f.ord, 'import-collision' FROM fine f JOIN many m ON m.source = f.source AND m.name = f.name
        WHERE m.ways > 1 OR EXISTS (SELECT 1 FROM tops t WHERE t.source = f.source AND t.name = f.name)""",
      _CANONICAL, _INNER, _INHERITED, _HELD, _STRANGE, """fine AS MATERIALIZED (SELECT DISTINCT source, ord, name, target_source, target_id FROM met WHERE seen AND (kind = 'TYPE' OR is_static)),
      tops AS MATERIALIZED (SELECT source, name, decl_id FROM g_decls WHERE kind = 'TYPE' AND scope_id = 0),
      many AS MATERIALIZED (SELECT w.source, w.name, w.ways FROM (SELECT source, name, count(DISTINCT ord) AS ways FROM fine GROUP BY ALL) w
        JOIN (SELECT source, name, count(*) AS n FROM (SELECT source, name, target_id FROM fine UNION SELECT source, name, decl_id FROM tops) GROUP BY ALL) t ON t.source = w.source AND t.name = w.name WHERE t.n > 1)"""),
    "b2_stage_order": _graph("""SELECT source, ref_id, stage, count(*) AS targets, sum(target_id)::BIGINT AS ids FROM (
        SELECT DISTINCT source, ref_id, stage, target_source, target_id FROM (SELECT *, min(stage) OVER (PARTITION BY source, ref_id) AS least FROM hits) WHERE stage = least) GROUP BY ALL""",
      _CANONICAL, _INNER, _INHERITED, _HELD, """rf AS MATERIALIZED (SELECT source, ref_id, scope_id, name FROM g_irefs UNION ALL SELECT source, decl_id, scope_id, type_name FROM g_decls WHERE kind = 'LOCAL'),
      body AS MATERIALIZED (SELECT r.source, r.ref_id, r.source AS ts, i.decl_id AS ti FROM rf r JOIN g_inner i ON i.source = r.source AND i.scope_id = (r.scope_id // 100) * 100 + 1 AND i.name = r.name
        UNION SELECT r.source, r.ref_id, i.target_source, i.target_id FROM rf r JOIN inh i ON i.source = r.source AND i.type_id = (r.scope_id // 100) * 1000 AND i.name = r.name),
      hits AS MATERIALIZED (SELECT source, ref_id, 1 AS stage, ts AS target_source, ti AS target_id FROM body
        UNION ALL SELECT r.source, r.ref_id, 1, d.source, d.decl_id FROM rf r JOIN g_decls d ON d.source = r.source AND d.kind = 'TYPE' AND d.name = r.name WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.source = r.source AND b.ref_id = r.ref_id)
        UNION ALL SELECT r.source, r.ref_id, 2, m.target_source, m.target_id FROM rf r JOIN met m ON m.source = r.source AND m.name = r.name AND m.seen AND (m.kind = 'TYPE' OR m.is_static)
        UNION ALL SELECT r.source, r.ref_id, 3, d.source, d.decl_id FROM rf r JOIN g_files f ON f.source = r.source
          JOIN (SELECT d.source, d.decl_id, d.name, g.package FROM g_decls d JOIN g_files g USING (source) WHERE d.kind = 'TYPE') d ON d.name = r.name AND d.package IS NOT DISTINCT FROM f.package
        UNION ALL SELECT r.source, r.ref_id, 4, h.target_source, h.target_id FROM rf r JOIN g_files f ON f.source = r.source JOIN (SELECT DISTINCT source, name AS parent, kind FROM asks WHERE kind LIKE '%ON_DEMAND') a ON a.source = r.source
          JOIN held h ON h.parent = a.parent AND h.name = r.name AND (a.kind = 'TYPE_ON_DEMAND' OR h.is_static) AND (h.access = 'PUBLIC' OR h.home = coalesce(f.package, chr(0))))"""),
    "b9_accessible_suggestions": _graph("""SELECT u.source, u.name, count(DISTINCT k.canonical) AS n, min(k.canonical) AS first FROM (SELECT DISTINCT source, name FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.source = r.source AND s.ref_id = r.ref_id)) u JOIN g_files f ON f.source = u.source
      JOIN (SELECT DISTINCT k.canonical, regexp_extract(k.canonical, '[^.]*$') AS name, CASE WHEN (k.decl_id // 1000) % 3 = 0 THEN g.package END AS only FROM canonical k JOIN g_files g USING (source) WHERE g.package IS NOT NULL) k
        ON k.name = u.name AND (k.only IS NULL OR k.only = f.package) GROUP BY ALL""", _CHAIN, _CANONICAL, _REFS, _stages()),
    "b11_parameter_bounds": _graph("SELECT source, decl_id, source AS target_source, bound_id AS target_id FROM behind UNION ALL SELECT source, decl_id, NULL, NULL FROM reach WHERE decl_id = bound_id", _BEHIND),
    "b11_bound_members": _graph("""SELECT DISTINCT h.source, h.ref_id, e.ts AS target_source, e.ti AS target_id FROM head h LEFT JOIN behind b ON b.source = h.source AND b.decl_id = h.id
      JOIN every e ON e.source = h.source AND e.outer_id = coalesce(b.bound_id, h.id) AND e.name = 'I' || (h.ref_id % 3)""", _LOCAL_HITS, _INHERITED, _BEHIND, _EVERY, """hit AS (SELECT source, ref_id, target_id FROM near
      UNION ALL SELECT r.source, r.ref_id, i.decl_id FROM g_irefs r JOIN g_inner i ON i.source = r.source AND i.scope_id = (r.scope_id // 100) * 100 + 1 AND i.name = r.name
      WHERE NOT EXISTS (SELECT 1 FROM near x WHERE x.source = r.source AND x.ref_id = r.ref_id)),
      head AS MATERIALIZED (SELECT source, ref_id, min(target_id) AS id FROM hit GROUP BY ALL HAVING count(DISTINCT target_id) = 1)"""),
}
