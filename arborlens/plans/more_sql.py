"""SQL that gives the same results as :mod:`arborlens.plans.more`, for DuckDB."""

from __future__ import annotations

from arborlens.functions.dims import ASSETS
from arborlens.plans import reference_sql as R
from arborlens.plans.problems_sql import plain
from arborlens.plans.reference import SKILLS
from arborlens.plans.views import NOW

_E, _F, _L, _H, _D, _C = R._EVENTS, R._FILES, R._EDGES, R._HUBS, R._DEGREE, R._CHANGED


def _stack(*sections: tuple[str, str, str, str]) -> str:
    """(section, item, n) of (name, item, n, from)."""
    return " UNION ALL ".join(f"SELECT '{name}' AS section, CAST({item} AS VARCHAR) AS item, CAST({n} AS BIGINT) AS n FROM {rows}" for name, item, n, rows in sections)


_AGENT = f"""edited AS (SELECT root, coalesce(lang, '') AS session, path, ts AS seen FROM fs_events WHERE ts IS NOT NULL AND path IS NOT NULL AND ts >= TIMESTAMP '{NOW}' - INTERVAL 5 DAY)"""

_TOP = "top AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY dst ORDER BY n DESC, dst LIMIT 1)"
_TOPHUBS = "tops AS (SELECT path, importers FROM hubs ORDER BY importers DESC, path LIMIT 5), firsts AS (SELECT path, src, row_number() OVER (PARTITION BY path ORDER BY src) AS nth FROM tops JOIN edges ON dst = path QUALIFY nth <= 3)"
_IMPACTED = "i AS (SELECT DISTINCT src AS path, dst AS via FROM edges WHERE dst IN (FROM changed) AND src NOT IN (FROM changed)), c AS (SELECT DISTINCT dst AS path, src AS via, dst IN (SELECT path FROM hubs) AS hub FROM edges WHERE src IN (FROM changed) AND dst NOT IN (FROM changed))"
_PER = "per AS (SELECT path, count(src) AS n FROM changed LEFT JOIN edges ON dst = path GROUP BY path)"

_NAMES = "x AS (SELECT DISTINCT dst, length(dst) % 8 AS k FROM edges)"

_DEPS = r"""reports AS (SELECT root, report_id, max(list_distinct_ordered) AS names FROM (SELECT root, report_id,
    list_filter(kept, lambda v, i: list_position(kept, v) = i) AS list_distinct_ordered FROM (SELECT root, report_id, list_transform(list_filter(coalesce(imports, []), lambda x: x IS NOT NULL AND trim(x) <> ''), lambda x: regexp_replace(x, '[^A-Za-z0-9_./-]', '', 'g')) AS kept FROM importers_report)) GROUP BY root, report_id),
  deps AS (SELECT DISTINCT root, CASE report_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'swift' ELSE 'csharp' END AS language, unnest(names) AS dep FROM reports)"""

_LASTN = f"""n20 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts DESC, event_id DESC) AS nth FROM e QUALIFY nth <= 20),
  lasts AS (SELECT root, path, lower(arg_min(op, nth)) AS op FROM n20 GROUP BY root, path),
  shown AS (SELECT root, path, CASE WHEN op IN ('remove', 'rename') AND (root, path) IN (SELECT (root, path) FROM f) THEN 'edited' ELSE op END AS op,
    greatest(count(*) OVER (PARTITION BY root) - 5, 0) AS more, row_number() OVER (PARTITION BY root ORDER BY path) AS nth FROM lasts QUALIFY nth <= 5)"""

_REAL = rf"""langs AS (SELECT *, {R._language("path")} AS language FROM f),
known AS (SELECT DISTINCT root, path, {R._FAMILY} AS family FROM langs WHERE language IS NOT NULL),
tails AS (SELECT root, path, family, unnest(generate_series(1, len(string_split(path, '/')))) AS i, string_split(path, '/') AS p FROM known),
idx0 AS (SELECT root, family, path, CASE WHEN i = 1 THEN 'exact' ELSE 'suffix' END AS kind, array_to_string(p[i:], '/') AS key FROM tails),
mods AS (SELECT DISTINCT root, 'example.org/' || {R._base("root")} AS module FROM f),
idx AS (SELECT * FROM idx0 UNION SELECT root, family, path, kind, regexp_replace(key, '\.[^./]*$', '') FROM idx0 UNION SELECT root, family, path, 'dir', {R._dir("path")} FROM known
  UNION SELECT root, family, path, 'go', CASE WHEN {R._dir("path")} = '' THEN module ELSE module || '/' || {R._dir("path")} END FROM known JOIN mods USING (root) WHERE family = 'go' AND NOT ends_with(path, '_test.go')),
before AS (SELECT root, path, file_id, lag(path) OVER (PARTITION BY root, ext ORDER BY file_id) AS prev FROM f WHERE ext <> ''),
parts AS (SELECT *, {R._language("path")} AS language, regexp_replace(prev, '\.[^./]*$', '') AS bare, {R._dir("prev")} AS pd FROM before WHERE prev IS NOT NULL),
texts AS (SELECT root, path AS src, language, CASE WHEN language = 'go' THEN 'import "' || module || CASE WHEN pd = '' THEN '' ELSE '/' || pd END || '"' WHEN language IN ('javascript', 'typescript') THEN 'import x from "' || CASE WHEN file_id % 2 = 0 THEN '@/' ELSE 'pkg/' END || bare || '";'
  WHEN language = 'rust' THEN 'use crate::' || replace(bare, '/', '::') || ';' WHEN language IN ('python', 'java') THEN 'import ' || replace(bare, '/', '.') WHEN language = 'csharp' THEN 'using ' || replace(bare, '/', '.') || ';'
  WHEN language = 'c' THEN '#include "' || prev || '"' ELSE 'require "' || bare || '"' END || E'\n' AS content FROM parts JOIN mods USING (root)),
specs AS (SELECT DISTINCT root, src, language, trim(unnest({R._extracted(R.IMPORTS)})) AS spec FROM texts WHERE language IS NOT NULL),
fam AS (SELECT s.*, module, {R._FAMILY} AS family, CASE WHEN starts_with(spec, 'crate::') THEN replace(substr(spec, 8), '::', '/') WHEN contains(spec, '.') AND NOT contains(spec, '/') THEN replace(spec, '.', '/') ELSE spec END AS norm FROM specs s JOIN mods USING (root)),
tries AS (SELECT root, src, spec, family, 100 AS strategy, 'go' AS kind, spec AS key FROM fam WHERE family = 'go' AND (spec = module OR starts_with(spec, module || '/'))
  UNION ALL SELECT root, src, spec, family, unnest([300, 301]), unnest(['exact', 'suffix']), substr(spec, 3) FROM fam WHERE family = 'js' AND starts_with(spec, '@/')
  UNION ALL SELECT root, src, spec, family, 400, 'exact', substr(spec, 5) FROM fam WHERE family = 'js' AND starts_with(spec, 'pkg/')
  UNION ALL SELECT root, src, spec, family, unnest([500, 600, 700]), unnest(['exact', 'suffix', 'dir']), norm FROM fam WHERE family NOT IN ('go', 'js')),
rungs AS (SELECT DISTINCT root, family, kind, key, unnest(generate_series(0, {len(R.LADDER) - 1})) AS rung, key || unnest([{R._list(R.LADDER)}]) AS full_key FROM tries WHERE kind IN ('exact', 'suffix') AND key <> ''
  UNION SELECT DISTINCT root, family, kind, key, 0, key FROM tries WHERE kind = 'go'
  UNION SELECT DISTINCT root, family, kind, key, unnest(generate_series(0, len(string_split(key, '/')) - 1)), unnest(list_transform(generate_series(1, len(string_split(key, '/'))), lambda i: array_to_string(string_split(key, '/')[i:], '/'))) FROM tries WHERE kind = 'dir'),
hits AS (SELECT r.root, r.family, r.kind, r.key, r.rung, idx.path FROM rungs r JOIN idx ON idx.root = r.root AND idx.family = r.family AND idx.kind = r.kind AND idx.key = r.full_key),
won AS (SELECT * FROM hits QUALIFY rung = min(rung) OVER (PARTITION BY root, family, kind, key) AND (kind <> 'go' OR count(*) OVER (PARTITION BY root, family, kind, key) = 1)),
resolved AS (SELECT DISTINCT root, src, spec, strategy, path AS dst FROM (SELECT t.*, w.path, min(strategy) OVER (PARTITION BY t.root, t.src, t.spec) AS best FROM tries t JOIN won w USING (root, family, kind, key)) WHERE strategy = best)"""


def _rendered(name: str, items: str, title: str) -> str:
    return f"""{name}0 AS (SELECT artifact_id, unnest(generate_series(0, len({items}) - 1)) AS nth, unnest({items}) AS x FROM a WHERE len({items}) > 0),
      {name} AS (SELECT artifact_id, E'\\n\\n## {title}\\n' || coalesce(string_agg('- ' || x.path, E'\\n' ORDER BY nth) FILTER (nth <= 5), '') || CASE WHEN count(*) > count(*) FILTER (nth <= 5) THEN E'\\n... and ' || (count(*) - count(*) FILTER (nth <= 5)) || ' more' ELSE '' END AS part FROM {name}0 WHERE x.path IS NOT NULL GROUP BY artifact_id)"""


def _skill(name: str, priority: int, keywords: list[str], languages: list[str], patterns: list[str]) -> str:
    """The points of one skill for every task that has any."""
    word = f"list_filter([{R._list(k.lower() for k in keywords)}], lambda k: k = category)" if keywords else "CAST([] AS VARCHAR[])"
    speaks = f"list_filter(speaks, lambda l: l IN ({R._list(languages)}))" if languages else "CAST([] AS VARCHAR[])"
    paths = "CAST([] AS VARCHAR[])"
    for p in patterns:
        if "*" in p or "?" in p:
            regex = "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\." if c == "." else c for c in p) + "$"
            hit = f"regexp_matches(f, '{regex}') OR regexp_matches({R._base('f')}, '{regex}')"
        else:
            hit = f"contains(f, '{p}')"
        paths = f"list_concat({paths}, list_filter(files, lambda f: {hit}))"
    return f"""SELECT id, '{name}' AS name, 3 * len({word}) + 2 * len({speaks}) + len({paths}) AS points, {priority // 5} AS extra,
      array_to_string(list_concat(list_concat(list_transform({word}, lambda k: 'category:' || category), list_transform({speaks}, lambda l: 'language:' || l)), list_transform({paths}, lambda f: 'path:' || f)), ', ') AS reason FROM tasks"""


_SKILLS = f"""tasks AS (SELECT m.id, category, found[:5] AS files, list_sort(list_distinct(list_filter(list_transform(found[:5], lambda p: {R._language("p")}), lambda l: l IS NOT NULL))) AS speaks FROM distinct_mentions m JOIN intent i ON i.id = m.id),
points AS ({" UNION ALL ".join(_skill(*s) for s in SKILLS)})"""

SQL = {
    "common_sources": f"""WITH {_F}, n AS (SELECT lower(ext) AS ext, count(*) AS files FROM f WHERE {R._language("path")} IS NOT NULL GROUP BY 1 ORDER BY files DESC, ext LIMIT 5) SELECT ext, files, CAST(sum(files) OVER () AS BIGINT) AS matched FROM n""",
    "depth_precedence": f"""WITH {_F} SELECT root, CAST(CASE WHEN length(root) % 3 > 0 THEN length(root) % 3 WHEN length(root) % 2 > 0 THEN length(root) % 2 WHEN count(*) > 5000 THEN 2 WHEN count(*) > 2000 THEN 3 ELSE 4 END AS INT) AS depth FROM f GROUP BY root""",
    "skyline_fitted": f"WITH {_F}, {R._CODE} SELECT ext, height FROM sky ORDER BY height DESC, bytes DESC, ext LIMIT 4",
    "system_facts": f"""WITH {_F}, {_L}, a AS (SELECT dst AS path FROM edges UNION SELECT path FROM f), n AS (SELECT dst AS path, max(length(dst) % 4) AS n FROM edges GROUP BY dst), o AS (SELECT path, sum(o) AS o FROM (SELECT src AS path, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY path)
      SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^[^/]*') ELSE '.' END AS system, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS functions, CAST(coalesce(sum(o), 0) AS BIGINT) AS dependencies, count(*) FILTER (o IS NULL) AS standalone
      FROM a LEFT JOIN n USING (path) LEFT JOIN o USING (path) GROUP BY 1""",
    "agent_files": """WITH once AS (SELECT DISTINCT artifact_id, written_at, agent_history, CASE WHEN json_valid(agent_history) THEN agent_history::JSON END AS v FROM handoff_artifact),
      twice AS (SELECT artifact_id, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v->>'$') THEN (v->>'$')::JSON END ELSE v END AS v FROM once), lists AS (SELECT row_number() OVER () AS rn, artifact_id, from_json(CASE json_type(v) WHEN 'OBJECT' THEN json_array(v) WHEN 'ARRAY' THEN v END, '["JSON"]') AS l FROM twice),
      held AS (SELECT * FROM lists WHERE l IS NOT NULL), flat AS (SELECT rn, i, unnest(generate_series(1, len(fs))) AS k, unnest(fs) AS x FROM (SELECT rn, i, from_json(CASE WHEN json_type(e->'files_edited') = 'ARRAY' THEN e->'files_edited' END, '["JSON"]') AS fs FROM (SELECT rn, unnest(generate_series(1, len(l))) AS i, unnest(l) AS e FROM held)) WHERE fs IS NOT NULL),
      named AS (SELECT rn, i, k, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'path' WHEN json_type(x) = 'VARCHAR' THEN x->>'$' END AS p FROM flat), firsts AS (SELECT rn, p, min((i, k)) AS place FROM named WHERE p IS NOT NULL GROUP BY rn, p), joined AS (SELECT rn, string_agg(p, E'\\n' ORDER BY place) AS files FROM firsts GROUP BY rn)
      SELECT DISTINCT artifact_id, CAST(least(len(l), 2) AS INT) AS entries, coalesce(files, '') AS files FROM held LEFT JOIN joined USING (rn)""",
    "go_recovered": f"""WITH {_F}, t AS (SELECT f.root, f.file_id % 3 <> 0 AS ok FROM f JOIN (SELECT DISTINCT file_id FROM contents WHERE content IS NOT NULL) c USING (file_id) WHERE {R._language("path")} = 'go')
      SELECT root, CASE WHEN bool_or(ok) THEN 'fallback' ELSE 'unavailable' END AS status, printf('recovered %d of %d files', count(*) FILTER (ok), count(*)) AS detail FROM t GROUP BY root""",
    "go_functions": f"""WITH {_F} SELECT file_id, CASE WHEN file_id % 3 = 2 THEN 'fmt' ELSE '' END AS imports, CASE WHEN file_id % 3 = 2 THEN 'A,B' ELSE '' END AS functions, file_id % 3 <> 2 AS skipped FROM f WHERE {R._language("path")} = 'go'""",
    "skill_match": f"""WITH {R._MENTIONS}, {R._INTENT}, {_SKILLS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY points + extra DESC, name) AS INT) AS nth, name, CAST(points + extra AS INT) AS score, reason FROM points WHERE points > 0 QUALIFY nth <= 3""",
    "resolve_real": f"WITH {_F}, {_REAL} SELECT * FROM resolved",
    "resolve_strategies": f"WITH {_F}, {_REAL} SELECT strategy, {R._language('src')} AS language, count(DISTINCT (root, src, spec)) AS imports FROM resolved GROUP BY 1, 2",
    "handoff_rendered": f"""WITH one AS (SELECT artifact_id, arg_max({{'b': branch, 'd': delta}}, written_at) AS o FROM handoff_artifact GROUP BY artifact_id), a AS (SELECT artifact_id, o.b AS branch, o.d AS delta FROM one), {_rendered("p1", "delta.changed", "Changed")}, {_rendered("p2", "delta.risk_files", "At risk")}, {_rendered("p3", "delta.recent_events", "Recent events")},
      t AS (SELECT artifact_id, '# ' || coalesce(branch, '?') || coalesce(p1.part, '') || coalesce(p2.part, '') || coalesce(p3.part, '') AS text FROM a LEFT JOIN p1 USING (artifact_id) LEFT JOIN p2 USING (artifact_id) LEFT JOIN p3 USING (artifact_id))
      SELECT artifact_id AS key, CAST(length(text) AS INT) AS letters, md5(text) AS text FROM t""",
    "op_drift": "SELECT 'drift' AS section, subsystem || ' ' || doc || ' ' || code AS item, CAST(behind AS BIGINT) AS n FROM (" + R.SQL["doc_drift"] + ")",
    "log_parsed": f"""WITH {_E} SELECT root, event_id AS nth, date_trunc('second', ts) AS ts, op, path, coalesce(lines, 0) AS lines, coalesce(delta, 0) AS delta, coalesce(dirty, false) AS dirty FROM e WHERE path <> ''""",
    "log_tail_lines": """WITH l AS (SELECT doc_id AS root, list_filter(string_split(text, E'\\n'), lambda x: trim(x, ' ') <> '') AS k FROM documents WHERE doc_kind = 'log'),
      t AS (SELECT root, k[greatest(len(k) - 19, 1):] AS k FROM l WHERE len(k) > 0) SELECT root, CAST(unnest(generate_series(1, len(k))) AS INT) AS nth, unnest(k) AS line FROM t""",
    "last_session": f"WITH {_E}, {_F}, {_LASTN} SELECT root, path, op, more FROM shown",
    "agent_edit_rows": f"WITH {_AGENT} SELECT root, session, count(*) AS edits, count(DISTINCT path) AS paths, max(epoch_us(seen)) AS last_us FROM edited GROUP BY root, session",
    "edits_by_session": f"WITH {_AGENT} SELECT root, session, string_agg(DISTINCT path, E'\\n' ORDER BY path) AS paths FROM edited WHERE session <> '' GROUP BY root, session",
    "working_split": f"WITH {_E}, {R._WORKING}, {_AGENT} SELECT root, path, edits, (root, path) IN (SELECT (root, path) FROM edited WHERE session = 'python') AS mine FROM working",
    "lease_count": f"SELECT root, count(DISTINCT path) AS leases FROM fs_events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR GROUP BY root",
    "usable_handoffs": "SELECT DISTINCT artifact_id FROM handoff_artifact WHERE generated_at >= TIMESTAMP '2016-01-19 00:00:00' AND branch = 'main' AND len(delta.changed) > 0",
    "notes_dedupe": """WITH n AS (SELECT root, concat_ws(' ', mode, coverage_status) AS detail, min(report_id) AS seq FROM importers_report WHERE concat_ws(' ', mode, coverage_status) <> '' GROUP BY 1, 2)
      SELECT root, string_agg(detail, '; ' ORDER BY seq, detail) AS notes FROM n GROUP BY root""",
    "coverage_merged": """WITH r AS (SELECT root, mode, CASE coverage_status WHEN 'complete' THEN 'authoritative' WHEN 'partial' THEN 'mixed' ELSE 'timeout' END AS status FROM importers_report),
      m AS (SELECT root, min(mode) AS m FROM r GROUP BY root), o AS (SELECT root, min(status) AS s, min(mode) AS d FROM r JOIN m USING (root) WHERE mode = m GROUP BY root), b AS (SELECT root, min(status) AS f, min(mode) AS g FROM r JOIN m USING (root) WHERE mode <> m GROUP BY root)
      SELECT root, CASE WHEN s = 'authoritative' THEN s WHEN f IN ('authoritative', 'mixed', 'fallback') AND s IN ('mixed', 'fallback') THEN 'mixed' WHEN f IN ('authoritative', 'mixed', 'fallback') THEN 'fallback' ELSE coalesce(s, f) END AS status,
        concat_ws('; ', d, g) AS detail FROM o FULL JOIN b USING (root)""",
    "transient_files": f"""WITH {_F}, p AS (SELECT file_id, path, CASE WHEN file_id % 7 = 0 THEN path || '.timestamp-17-ab.mjs' ELSE path END AS q FROM f)
      SELECT file_id, contains({R._base("q")}, '.timestamp-') AS transient, {R._language("q")} IS NOT NULL AND NOT contains({R._base("q")}, '.timestamp-') AS source FROM p""",
    "asset_files": f"""WITH {_F}, x AS (SELECT file_id, CASE file_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.lock' ELSE ext END AS x FROM f) SELECT file_id FROM x WHERE x IS NULL OR x = '' OR lower(x) IN ({R._list(ASSETS)})""",
    "control_split": f"""WITH {_E}, t AS (SELECT root, CASE event_id % 11 WHEN 0 THEN 'ignores' WHEN 1 THEN 'config' ELSE CASE WHEN {R._language("path")} IS NOT NULL AND NOT contains({R._base("path")}, '.timestamp-') THEN 'data' END END AS control FROM e)
      SELECT root, control, count(*) AS events FROM t WHERE control IS NOT NULL GROUP BY root, control""",
    "membership": f"""WITH {_E}, {_F}, l AS (SELECT root, path, arg_max(op, (ts, event_id)) AS op FROM e GROUP BY root, path)
      SELECT root, path FROM l WHERE op IN ('CREATE', 'WRITE') UNION SELECT root, path FROM f WHERE (root, path) NOT IN (SELECT (root, path) FROM l)""",
    "colours_removed": "SELECT doc_id, coalesce(source, '') || coalesce(doc_kind, '') AS text FROM documents",
    "rust_literals": """SELECT doc_id, doc_kind || '\\"x' || '|' || source || ' "q" ' AS strings FROM documents WHERE doc_kind IS NOT NULL AND source IS NOT NULL""",
    "import_statements": f"""WITH {_L}, {_NAMES} SELECT CASE k WHEN 0 THEN '#include <' || dst || '>' WHEN 1 THEN 'source ' || dst WHEN 2 THEN 'import "' || dst || '"' WHEN 3 THEN 'const a = require(''' || dst || ''')' WHEN 4 THEN 'import ' || dst || ' as y'
      WHEN 5 THEN 'from ' || dst || ' import y' WHEN 6 THEN 'use ' || dst || '::inner;' ELSE 'nothing ' || dst END AS statement, CASE WHEN k = 7 THEN '' ELSE dst END AS path FROM x""",
    "function_heads": f"""WITH {_L}, {_NAMES} SELECT dst, 'f_' || regexp_replace({R._base("dst")}, '\\W', '_', 'g') AS name FROM x""",
    "external_deps": f"WITH {_DEPS} SELECT root, language, dep FROM deps WHERE dep <> ''",
    "external_shown": rf"""WITH {_DEPS}, o AS (SELECT root, language, CASE WHEN regexp_matches(regexp_replace(dep, '^.*/', ''), '^v\d+$') AND contains(dep, '/') THEN regexp_replace(regexp_replace(dep, '/[^/]*$', ''), '^.*/', '') ELSE regexp_replace(dep, '^.*/', '') END AS name FROM deps WHERE dep <> '')
      SELECT root, CASE language {{order}} END AS ord, CAST(count(DISTINCT name) AS INT) AS names FROM o WHERE NOT regexp_matches(name, '^v\d+$') AND length(name) > 1 GROUP BY root, language""",
    "artifacts_normalised": """SELECT DISTINCT artifact_id, written_at, CAST(coalesce(len(prefix.hubs), 0) AS INT) AS hubs, CAST(coalesce(len(delta.changed), 0) AS INT) AS changed, CAST(coalesce(len(delta.next_steps), 0) AS INT) AS steps, 133 AS digits, CASE WHEN artifact_id % 3 < 2 THEN true END AS chained FROM handoff_artifact""",
    "op_structure": f"""WITH {_F}, {_L}, {_H}, {_TOPHUBS}, s AS (SELECT * FROM f WHERE {R._NOT_IGNORED}), n AS (SELECT count(*) AS n FROM s),
      x AS (SELECT ext, count(*) AS n FROM s WHERE ext <> '' GROUP BY ext ORDER BY n DESC, ext LIMIT 5), top1 AS (SELECT string_split(path, '/')[1] AS dir, count(*) AS n FROM s WHERE contains(path, '/') GROUP BY 1)
      {_stack(("files", "'files'", "n", "n"), ("bytes", "'bytes'", "sum(size)", "s"), ("depth", "'depth'", "CASE WHEN n > 5000 OR n = 0 THEN 2 WHEN n > 2000 THEN 3 ELSE 4 END", "n"), ("extensions", "ext", "n", "x"), ("hubs", "path", "importers", "tops"), ("hub_importers", "path || ' <- ' || src", "nth", "firsts"), ("directories", "dir", "n", "top1"))}""",
    "op_skyline": f"""WITH {_F}, {R._CODE}, n AS (SELECT *, row_number() OVER (ORDER BY height DESC, bytes DESC, ext) - 1 AS nth FROM sky)
      {_stack(("height", "ext", "height", "sky"), ("place", "ext", "CASE WHEN nth % 2 = 0 THEN nth // 2 ELSE -((nth + 1) // 2) END", "n"))}""",
    "op_flow": f"""WITH {_L}, {_C}, b AS (SELECT src, dst FROM edges WHERE src IN (FROM changed) AND dst IN (FROM changed)), sy AS (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^[^/]*') ELSE '.' END AS s, count(*) AS n FROM changed GROUP BY 1),
      nm AS (SELECT n, array_to_string(list_transform(list_filter(string_split(replace(replace(s, '_', ' '), '-', ' '), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS name FROM sy)
      {_stack(("systems", "name", "n", "nm"), ("edges", "src || ' -> ' || dst", "1", "b"), ("hubs", "dst", "n", "(SELECT dst, count(*) AS n FROM b GROUP BY dst HAVING count(*) >= 2)"), ("external", "l", "o", "(VALUES ('Go: zap, net', {{go}}), ('Python: numpy', {{python}})) v(l, o)"))}""",
    "op_importers": f"""WITH {_L}, {_H}, {_TOP} {_stack(("count", "path", "n", "top"), ("hub", "path", "CAST(path IN (SELECT path FROM hubs) AS INT)", "top"), ("importers", "src", "1", "(SELECT src FROM edges JOIN top ON dst = path ORDER BY src LIMIT 500)"), ("hub_imports", "dst", "1", "(SELECT dst FROM edges JOIN top ON src = path WHERE dst IN (SELECT path FROM hubs))"))}""",
    "op_hubs": f"WITH {_L}, {_H}, {_TOPHUBS} {_stack(('hubs', 'path', 'importers', 'tops'), ('importers', chr(112) + 'ath || ' + repr(' <- ') + ' || src', 'nth', 'firsts'))}",
    "op_file_context": f"""WITH {_L}, {_H}, {_TOP}, ins AS (SELECT src FROM edges JOIN top ON dst = path), outs AS (SELECT dst FROM edges JOIN top ON src = path)
      {_stack(("imports", "dst", "1", "outs"), ("importers", "src", "1", "ins"), ("connected", "o", "1", "(SELECT src AS o FROM ins UNION SELECT dst FROM outs) z WHERE o NOT IN (SELECT path FROM top)"), ("facts", "path", "2 * n + CAST(path IN (SELECT path FROM hubs) AS INT)", "top"))}""",
    "op_changes": f"""WITH {_L}, {_C}, {_F}, fs AS (SELECT path FROM changed UNION ALL SELECT DISTINCT path FROM f), k AS (SELECT src AS path, regexp_replace({R._base("dst")}, '\\.[^.]*$', '') AS k FROM edges),
      ch AS (SELECT fs.path FROM fs WHERE path IN (FROM changed)), bases AS (SELECT regexp_replace({R._base("path")}, '\\.[^.]*$', '') AS k, max(path) AS target FROM ch GROUP BY 1),
      dirs AS (SELECT {R._base("d")} AS k, arg_min(d, path) AS target FROM (SELECT path, {R._dir("path")} AS d FROM ch) WHERE d <> '' GROUP BY 1),
      hits AS (SELECT target FROM k JOIN bases USING (k) WHERE path <> target UNION ALL SELECT target || '/' FROM k JOIN dirs USING (k) WHERE {R._dir("path")} <> target)
      {_stack(("changed", "path", "3", "ch"), ("impact", "target", "n", "(SELECT target, count(*) AS n FROM hits GROUP BY target)"))}""",
    "op_blast": f"""WITH {_L}, {_C}, {_H}, {_D}, {_IMPACTED}, {_PER}
      {_stack(("changed", "path", "3", "(SELECT path FROM changed ORDER BY path LIMIT 60)"), ("impacted", "path || ' via ' || via", "n", "(SELECT i.path, via, importers AS n FROM i JOIN degree g ON g.path = via ORDER BY n DESC, i.path, via LIMIT 12)"),
        ("context", "path || ' via ' || via", "CAST(hub AS INT)", "(SELECT * FROM c ORDER BY hub DESC, path, via LIMIT 8)"), ("summary", "CASE WHEN max(n) > 0 THEN arg_min(path, (-n, path)) END", "(SELECT count(DISTINCT path) FROM i)", "per"), ("reports", "path", "n", "per"))}""",
    "op_find": f"""WITH {_F}, q AS (SELECT root || '/' || path AS path, {R._EXT_BARE} AS x FROM f), h AS (SELECT path, x IN ('go', 'py') AS v FROM q WHERE contains(lower(path), 'cache') AND NOT contains('/' || path || '/', '/vendor/') AND NOT ends_with(lower(path), '.vendor') AND (x IN ('go', 'py') OR x <> 'c'))
      {_stack(("found", "path", "1", "h WHERE v"), ("hidden", "path", "1", "h WHERE NOT v"))}""",
    "op_activity": f"""WITH {_E}, r AS (SELECT * FROM e WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 3 DAY), t AS (SELECT root, path, count(*) AS n FROM r WHERE op IN ('CREATE', 'WRITE') GROUP BY root, path)
      {_stack(("summary", "root", "n", "(SELECT root, sum(n) AS n FROM t GROUP BY root)"), ("files", "root || ':' || path", "n", "(SELECT * FROM t ORDER BY n DESC, root, path LIMIT 10)"), ("timeline", "path", "event_id", "(SELECT * FROM r ORDER BY ts DESC, path DESC, op DESC, event_id DESC LIMIT 5)"))}""",
    "op_working": f"""WITH {_E}, {R._WORKING}, {R._COUNTS} {_stack(("hot", "root || ':' || path", "edits", "(SELECT * FROM working ORDER BY edits DESC, last_touch DESC, root, path LIMIT 10)"), ("hubs", "root", "n", "(SELECT root, count(*) FILTER (coalesce(importers, 0) >= 3) AS n FROM working LEFT JOIN counts USING (path) GROUP BY root)"))}""",
    "op_handoff": f"""WITH {_E}, {_F}, {_L}, {_C}, n AS (SELECT count(*) AS n FROM f), ok AS (SELECT path FROM changed WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.arborlens', 'node_modules', 'vendor', 'dist', 'build', 'target', '__pycache__', '.next', '.nuxt']) AND NOT lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ({R._list(R.BINARY)})),
      hb AS (SELECT dst AS path, count(*) AS importers FROM edges GROUP BY dst HAVING count(*) >= 3), rk AS (SELECT dst AS path, count(*) AS n FROM edges WHERE dst IN (FROM ok) GROUP BY dst HAVING count(*) >= 2)
      {_stack(("budget", "'changed'", "CASE WHEN n > 5000 THEN 25 WHEN n > 2000 THEN 40 ELSE 60 END", "n"), ("changed", "path", "CAST(n IS NOT NULL AS INT)", "(SELECT path, n FROM ok LEFT JOIN rk USING (path) ORDER BY n IS NULL, n DESC, path LIMIT 60)"), ("risk", "path", "n", "rk"), ("hubs", "path", "importers", "hb"),
        ("events", "path", "event_id", f"(SELECT * FROM e WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR ORDER BY ts DESC, path DESC, op DESC, event_id DESC LIMIT 25)"), ("hashes", "'letters'", "64", "(VALUES (1), (2)) v(x)"))}""",
    "op_handoff_file": f"""WITH {_E}, {_L}, w AS (SELECT path FROM e GROUP BY path ORDER BY count(*) DESC, path LIMIT 1) {_stack(("events", "path", "event_id", "(SELECT * FROM e WHERE path IN (FROM w) ORDER BY ts DESC, path DESC, op DESC, event_id DESC LIMIT 25)"), ("importers", "src", "1", "edges WHERE dst IN (FROM w)"))}""",
    "op_envelope": f"""WITH {R._MENTIONS}, {R._INTENT}, said AS (SELECT id, unnest(generate_series(1, least(len(found), 20))) - 1 AS pos, unnest(found[:20]) AS m FROM distinct_mentions),
      fl AS (SELECT DISTINCT p FROM (SELECT unnest(found) AS p FROM distinct_mentions) WHERE length(p) % 2 = 0), nm AS (SELECT id, path, min(pos) AS pos FROM (SELECT id, pos, {plain("m", "''")} AS path FROM said) WHERE path IN (SELECT p FROM fl) GROUP BY id, path),
      sc AS (SELECT d.doc_id AS id, CASE WHEN count(path) = 0 THEN 'unknown' WHEN count(path) = 1 THEN 'single-file' WHEN count(DISTINCT {R._dir("path")}) <= 1 THEN 'package' ELSE 'cross-cutting' END AS scope FROM documents d LEFT JOIN nm ON nm.id = d.doc_id GROUP BY 1),
      rs AS ({R._SUBSYSTEMS}), rt AS (SELECT id, subsystem, score FROM rs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, subsystem) <= 3)
      {_stack(("intent", "id || ' ' || category", "score", "intent"), ("files", "id || ' ' || path", "pos", "nm"), ("scope", "id || ' ' || scope", "1", "sc"), ("routes", "id || ' ' || subsystem", "score", "rt"))}""",
    "op_session_start": f"""WITH {_E}, {_F}, {_L}, {_H}, {_TOPHUBS}, {_LASTN} {_stack(("files", "'files'", "count(*)", f"f WHERE {R._NOT_IGNORED}"), ("hubs", "path", "importers", "tops"), ("last", "root || ' ' || path || ' ' || op", "more", "shown"))}""",
    "op_edit_check": f"""WITH {_L}, {_C}, {_H}, {_PER} {_stack(("report", "path", "n", "per"), ("hub_imports", "src || ' -> ' || dst", "1", "edges WHERE src IN (FROM changed) AND dst IN (SELECT path FROM hubs)"))}""",
    "op_session_stop": f"""WITH {_L}, {_C}, {_H} {_stack(("summary", "'r'", "count(*)", "changed"), ("hub_edits", "path", "importers", "hubs WHERE path IN (FROM changed)"))}""",
}

_ORDER = {"go": 0, "python": 0, "javascript": 0, "swift": 0, "csharp": 0}


def _ordered() -> None:
    from arborlens.sources.manifests import ORDER

    for lang in _ORDER:
        _ORDER[lang] = list(ORDER).index(lang) + 1
    SQL["external_shown"] = SQL["external_shown"].replace("{order}", " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ORDER.items()))
    SQL["op_flow"] = SQL["op_flow"].replace("{{go}}", str(_ORDER["go"])).replace("{{python}}", str(_ORDER["python"])).replace("{go}", str(_ORDER["go"])).replace("{python}", str(_ORDER["python"]))


_ordered()
