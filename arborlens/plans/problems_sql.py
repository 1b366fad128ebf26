"""SQL that gives the same results as :mod:`arborlens.plans.problems`, for DuckDB."""

from __future__ import annotations


def plain(path: str, root: str) -> str:
    """The plain form of a path, as SQL: it undoes detours of up to three ``..``."""
    s = rf"replace(regexp_replace({path}, '^\s+|\s+$', '', 'g'), '\', '/')"
    s = f"CASE WHEN starts_with({s}, {root} || '/') THEN substr({s}, length({root}) + 2) ELSE {s} END"
    s = rf"regexp_replace(regexp_replace({s}, '/+', '/', 'g'), '^/|/$', '', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '(/\.)+(/|$)', '\2', 'g'), '^(\./)+', '')"
    for _ in range(3):
        s = rf"regexp_replace({s}, '(^|/)[^/]+/\.\./', '\1')"
    return s


#: The sound events, each once.
SOUND = f"""
SELECT DISTINCT ON (event_id) event_id, root, ts, upper(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) AS op,
  {plain("path", "root")} AS path, coalesce(delta, 0) AS delta
FROM fs_events
WHERE ts IS NOT NULL AND upper(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) IN ('CREATE', 'WRITE', 'REMOVE', 'RENAME')
ORDER BY event_id, received_at
"""

_SESSIONS = f"""
WITH sound AS ({SOUND}),
marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM sound WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts, event_id) AS s FROM marked),
sessions AS (
  SELECT root, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id,
    min(ts) AS started_at, max(ts) AS ended_at, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, count(*) AS events
  FROM numbered GROUP BY root, s)
"""

_IMPORTERS = f"""
exploded AS (SELECT {plain("file", "root")} AS path, root, unnest(importers) AS importer FROM importers_report),
pairs AS (SELECT DISTINCT path, {plain("importer", "root")} AS importer FROM exploded WHERE path IS NOT NULL)
"""

_HUBS = f"""
hubs AS (SELECT {plain("path", "root")} AS path, snapshot_id, importers FROM hub_summary WHERE path IS NOT NULL)
"""

_TREES = r"""
RECURSIVE recs AS (SELECT lineage, file_name, file_written_at, payload::JSON AS j FROM handoff_raw WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
nodes AS (SELECT DISTINCT lineage, file_name, replace(regexp_replace(regexp_replace(t.fullkey, '\[\d+\]', '[]', 'g'), '^\$\.?', ''), '"', '') AS path,
  CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind
  FROM recs, json_tree(j) t WHERE t.type <> 'NULL'),
types AS (SELECT lineage, file_name, path, string_agg(kind, '|' ORDER BY kind) AS kinds,
  CASE WHEN path LIKE '%[]' THEN left(path, length(path) - 2) WHEN contains(path, '.') THEN regexp_replace(path, '\.[^.]*$', '') ELSE '' END AS parent FROM nodes GROUP BY lineage, file_name, path),
steps AS (SELECT lineage, file_name, lag(file_name) OVER (PARTITION BY lineage ORDER BY min(file_written_at), file_name) AS before FROM recs GROUP BY lineage, file_name),
old AS (SELECT s.file_name AS f, t.* FROM steps s JOIN types t ON t.lineage IS NOT DISTINCT FROM s.lineage AND t.file_name = s.before),
new AS (SELECT s.file_name AS f, t.* FROM steps s JOIN types t ON t.lineage IS NOT DISTINCT FROM s.lineage AND t.file_name = s.file_name WHERE s.before IS NOT NULL),
retyped AS (SELECT o.f, o.path FROM old o JOIN new n ON o.f = n.f AND o.lineage = n.lineage AND o.path = n.path WHERE o.kinds <> n.kinds),
gone AS (SELECT o.f, o.lineage, o.path, o.kinds, o.parent FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.f = o.f AND n.lineage = o.lineage AND n.path = o.path)
  AND EXISTS (SELECT 1 FROM new n WHERE n.f = o.f AND n.lineage = o.lineage AND n.path = o.parent)),
come AS (SELECT n.f, n.lineage, n.path, n.kinds, n.parent FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.f = o.f AND n.lineage = o.lineage AND n.path = o.path)
  AND EXISTS (SELECT 1 FROM old o WHERE n.f = o.f AND n.lineage = o.lineage AND o.path = n.parent)),
sides AS (SELECT *, 'gone' AS side FROM gone UNION ALL SELECT *, 'come' FROM come),
counted AS (SELECT *, count(*) FILTER (side = 'gone') OVER w AS g, count(*) FILTER (side = 'come') OVER w AS c, min(path) FILTER (side = 'gone') OVER w AS a, min(path) FILTER (side = 'come') OVER w AS z
  FROM sides WINDOW w AS (PARTITION BY f, lineage, parent, kinds)),
changes AS (SELECT f, 'retyped' AS change_kind, path AS old_path, path AS new_path, path FROM retyped
  UNION ALL SELECT DISTINCT f, 'renamed', a, z, a FROM counted WHERE g = 1 AND c = 1
  UNION ALL SELECT f, 'removed', path, '', path FROM counted WHERE side = 'gone' AND NOT (g = 1 AND c = 1)
  UNION ALL SELECT f, 'added', '', path, path FROM counted WHERE side = 'come' AND NOT (g = 1 AND c = 1))
SELECT f AS file_name, change_kind, old_path, new_path FROM changes x
WHERE NOT EXISTS (SELECT 1 FROM retyped r WHERE r.f = x.f AND (starts_with(x.path, r.path || '.') OR starts_with(x.path, r.path || '[]')))
"""

_MOVES = _TREES.replace("SELECT f AS file_name, change_kind", ", told AS (SELECT f, change_kind", 1).rstrip() + r"""),
gone_shapes AS (SELECT t.f, t.old_path AS p, regexp_extract(t.old_path, '[^.]*$') AS name, string_agg(substr(o.path, length(t.old_path) + 1) || ':' || o.kinds, ',' ORDER BY o.path) AS shape FROM told t
  JOIN old o ON o.f = t.f AND (o.path = t.old_path OR starts_with(o.path, t.old_path || '.') OR starts_with(o.path, t.old_path || '[]')) WHERE t.change_kind = 'removed' GROUP BY t.f, t.old_path),
come_shapes AS (SELECT t.f, t.new_path AS p, regexp_extract(t.new_path, '[^.]*$') AS name, string_agg(substr(n.path, length(t.new_path) + 1) || ':' || n.kinds, ',' ORDER BY n.path) AS shape FROM told t
  JOIN new n ON n.f = t.f AND (n.path = t.new_path OR starts_with(n.path, t.new_path || '.') OR starts_with(n.path, t.new_path || '[]')) WHERE t.change_kind = 'added' GROUP BY t.f, t.new_path),
went AS (SELECT f, name, shape, min(p) AS p FROM gone_shapes GROUP BY f, name, shape HAVING count(*) = 1), came AS (SELECT f, name, shape, min(p) AS p FROM come_shapes GROUP BY f, name, shape HAVING count(*) = 1),
moved AS (SELECT w.f, w.p AS old_path, c.p AS new_path FROM went w JOIN came c ON c.f = w.f AND c.name = w.name AND c.shape = w.shape)
SELECT f AS file_name, change_kind, old_path, new_path FROM told t WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.f = t.f AND (t.change_kind = 'removed' AND m.old_path = t.old_path OR t.change_kind = 'added' AND m.new_path = t.new_path))
UNION ALL SELECT f, 'moved', old_path, new_path FROM moved"""

_ARTIFACTS = r"""
best AS (SELECT * FROM handoff_artifact QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY written_at DESC) = 1),
once AS (SELECT artifact_id, CASE WHEN json_valid(agent_history) THEN agent_history::JSON END AS v FROM best),
twice AS (SELECT artifact_id, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v->>'$') THEN (v->>'$')::JSON END ELSE v END AS v FROM once),
lists AS (SELECT artifact_id, from_json(CASE json_type(v) WHEN 'OBJECT' THEN json_array(v) WHEN 'ARRAY' THEN v END, '["JSON"]') AS l FROM twice),
entries AS (SELECT artifact_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS pos, unnest(l) AS e FROM lists WHERE l IS NOT NULL),
agents AS (SELECT * FROM entries WHERE json_type(e) <> 'NULL'),
edited AS (SELECT artifact_id, pos AS outer_pos, from_json(CASE WHEN json_type(e->'files_edited') = 'ARRAY' THEN e->'files_edited' END, '["JSON"]') AS l FROM agents),
files1 AS (SELECT artifact_id, outer_pos, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS pos, unnest(l) AS x FROM edited WHERE l IS NOT NULL)
"""


def _child(name: str, array: str, item: str) -> str:
    return f"SELECT artifact_id, '{name}' AS child, -1 AS outer_pos, pos, {item} AS item_key FROM (SELECT artifact_id, CAST(unnest(generate_series(0, len({array}) - 1)) AS INT) AS pos, unnest({array}) AS x FROM best WHERE {array} IS NOT NULL) WHERE x IS NOT NULL"


_CHILDREN = " UNION ALL ".join(
    [_child("hubs", "prefix.hubs", "x.path"), *(_child(n, f"delta.{n}", "x.path") for n in ("changed", "risk_files", "recent_events")), *(_child(n, f"delta.{n}", "x") for n in ("next_steps", "open_questions"))]
)

SQL = {
    "p2_found": f"""WITH {_IMPORTERS}, {_HUBS}, spairs AS (SELECT DISTINCT path, snapshot_id FROM hubs WHERE snapshot_id IS NOT NULL)
      SELECT 'importers_report' AS origin, path FROM pairs WHERE importer IS NOT NULL GROUP BY path
        HAVING count(*) >= 0.01 * (SELECT count(*) FROM pairs WHERE importer IS NOT NULL)
      UNION ALL
      SELECT 'hub_summary', path FROM spairs GROUP BY path HAVING count(*) >= 0.01 * (SELECT count(*) FROM spairs)""",
    "p2_importers": f"""WITH {_IMPORTERS}, named AS (SELECT DISTINCT {plain("file", "root")} AS path FROM importers_report WHERE file IS NOT NULL), n AS (SELECT path, count(importer) AS importers FROM pairs GROUP BY path)
      SELECT path, coalesce(importers, 0) AS importers FROM named LEFT JOIN n USING (path)""",
    "p2_snapshots": f"WITH {_HUBS} SELECT path, count(DISTINCT snapshot_id) AS snapshots, max(importers) AS most_importers FROM hubs GROUP BY path",
    "p3_found": f"WITH {_TREES}",
    "p3_moves": f"WITH {_MOVES}",
    "p5_found": f"{_SESSIONS} SELECT root, first_event_id, last_event_id FROM sessions",
    "p5_sessions": f"{_SESSIONS} SELECT root, first_event_id, last_event_id, started_at, ended_at, duration_us, events FROM sessions",
    "p5_ambiguous_ids": """WITH n AS (SELECT event_id, count(DISTINCT (root, ts)) AS n FROM fs_events WHERE ts IS NOT NULL AND upper(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) IN ('CREATE', 'WRITE', 'REMOVE', 'RENAME') GROUP BY event_id)
      SELECT count(*) AS ids, count(*) FILTER (n > 1) AS ambiguous FROM n""",
    "p5_streamed": f"{_SESSIONS} SELECT root, first_event_id, last_event_id FROM sessions",
    "p6_found": f"""WITH {_ARTIFACTS} {_CHILDREN}
      UNION ALL SELECT artifact_id, 'agent_history', -1, pos, e->>'agent_id' FROM agents
      UNION ALL SELECT artifact_id, 'files_edited', outer_pos, pos, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'path' ELSE x->>'$' END FROM files1 WHERE json_type(x) <> 'NULL'""",
    "p6_edits": f"""WITH {_ARTIFACTS}, edits AS (SELECT artifact_id, outer_pos, pos AS file_pos, from_json(CASE WHEN json_type(x->'edits') = 'ARRAY' THEN x->'edits' END, '["JSON"]') AS l FROM files1 WHERE json_type(x) = 'OBJECT'),
      single AS (SELECT artifact_id, outer_pos AS agent_pos, file_pos, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS pos, unnest(l) AS d FROM edits WHERE l IS NOT NULL)
      SELECT artifact_id, agent_pos, file_pos, pos, CAST(d->>'line' AS BIGINT) AS line, CAST(d->>'delta' AS BIGINT) AS delta FROM single WHERE json_type(d) <> 'NULL'""",
    "p6_artifacts": f"WITH {_ARTIFACTS} SELECT artifact_id, schema_version, generated_at, written_at, root, branch, base_ref, prefix.file_count AS prefix_file_count FROM best",
}
