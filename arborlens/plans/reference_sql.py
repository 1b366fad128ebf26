"""SQL that gives the same results as :mod:`arborlens.plans.reference`, for DuckDB."""

from __future__ import annotations

from arborlens.functions.dims import ASSETS, CODE_EXTENSIONS, CODE_NAMES, EXTENSIONS, FAMILIES, IGNORED, LADDER, SIGNALS, STATUSES
from arborlens.functions.extract import FUNCTIONS, IMPORTS
from arborlens.operators.handoff import BINARY
from arborlens.plans.problems_sql import plain
from arborlens.plans.views import CHANGED_SINCE, NOW


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _base(p: str) -> str:
    return f"regexp_replace({p}, '^.*/', '')"


def _dir(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"


def _language(p: str) -> str:
    return _case(EXTENSIONS, f"lower(regexp_extract({_base(p)}, '\\.[^.]*$'))")


def _test(p: str) -> str:
    return f"regexp_matches(lower({_base(p)}), '_test\\.go$|^test_.*\\.py$|\\.(test|spec)\\.[^.]*$|\\.(test|spec)$')"


_FILES = f"""files0 AS (
  SELECT file_id, root, {plain("path", "root")} AS path, size, added, removed, coalesce(is_new, false) AS is_new
  FROM files WHERE file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY path NULLS FIRST, root NULLS FIRST, size NULLS FIRST, added NULLS FIRST, removed NULLS FIRST, is_new NULLS FIRST) = 1),
f AS (SELECT *, regexp_extract({_base("path")}, '\\.[^.]*$') AS ext FROM files0)"""

_EDGES = f"""links AS (
  SELECT root, unnest(importers) AS src, file AS dst FROM importers_report UNION ALL SELECT root, file, unnest(imports) FROM importers_report),
edges AS (SELECT DISTINCT * FROM (SELECT {plain("src", "root")} AS src, {plain("dst", "root")} AS dst FROM links) WHERE src IS NOT NULL AND dst IS NOT NULL)"""

_CHANGED = f"""changed AS (SELECT DISTINCT path FROM (SELECT {plain("file", "root")} AS path FROM importers_report WHERE reported_at >= TIMESTAMP '{CHANGED_SINCE}') WHERE path IS NOT NULL)"""

_HUBS = f"""hubs AS (SELECT dst AS path, count(*) AS importers FROM edges WHERE NOT {_test("src")} AND NOT {_test("dst")} GROUP BY dst HAVING count(*) >= 3)"""

_DEGREE = f"""degree AS (SELECT path, CAST(sum(i) AS BIGINT) AS importers, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(c) AS BIGINT) AS counted FROM (
  SELECT dst AS path, 1 AS i, 0 AS o, CAST(NOT {_test("src")} AS INT) AS c FROM edges UNION ALL SELECT src, 0, 1, 0 FROM edges) GROUP BY path)"""

_EVENTS = f"""e AS (SELECT DISTINCT ON (event_id) event_id, root, ts, upper(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) AS op, {plain("path", "root")} AS path, lines, size, delta, dirty
  FROM fs_events WHERE ts IS NOT NULL AND upper(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) IN ('CREATE', 'WRITE', 'REMOVE', 'RENAME')
  ORDER BY event_id, received_at NULLS FIRST)"""

_WORKING = """gone AS (SELECT root, path, max((ts, event_id)) FILTER (op IN ('REMOVE', 'RENAME')) AS gone FROM e GROUP BY root, path),
working AS (SELECT root, path, min(ts) AS first_touch, max(ts) AS last_touch, count(*) AS edits, CAST(coalesce(sum(delta), 0) AS BIGINT) AS net_delta
  FROM e JOIN gone USING (root, path) WHERE op IN ('CREATE', 'WRITE') AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY root, path)"""

_COUNTS = "counts AS (SELECT path, count(DISTINCT root) AS importers FROM e GROUP BY path)"

_EXTS = sorted({x[1:] for x in EXTENSIONS}, key=lambda x: (-len(x), x))
_MENTIONS = "mentions AS (SELECT doc_id AS id, list_reduce([" + ", ".join(f"regexp_extract_all(text, '([a-zA-Z0-9_/.@-]+\\.{x}\\b)', 1)" for x in _EXTS) + """], lambda a, b: list_concat(a, b)) AS found FROM documents),
distinct_mentions AS (SELECT id, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM mentions)"""
_NAMED = "named AS (SELECT id, unnest(generate_series(1, greatest(len(found[:5]), 1))) - 1 AS pos, unnest(CASE WHEN len(found) = 0 THEN [NULL] ELSE found[:5] END) AS path FROM distinct_mentions)"

_CATEGORIES = list(dict.fromkeys(c for c, *_ in SIGNALS))
_POINTS = {c: " + ".join(f"CASE WHEN contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for k, _, p, w in SIGNALS if k == c) for c in _CATEGORIES}
_SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT doc_id AS id, '{c}' AS category, {i} AS ord, CAST({p} AS INT) AS score FROM documents" for i, (c, p) in enumerate(_POINTS.items())) + ")"
_INTENT = f"""{_SCORES}, intent AS (SELECT id, CASE WHEN max(score) > 0 THEN arg_max(category, (score, -ord)) ELSE 'feature' END AS category, max(score) AS score, CAST(sum(score) AS INT) AS total,
  CASE WHEN sum(score) > 0 THEN max(score) / sum(score) ELSE 0.0 END AS confidence, CASE WHEN sum(score) > 0 THEN max(score) / sum(score) ELSE 0.0 END >= 0.5 AS sure FROM scores GROUP BY id)"""

_LINE = """concat_ws(' | ', strftime(ts, '%Y-%m-%d %H:%M:%S'), op || repeat(' ', greatest(6 - length(op), 0)), path || repeat(' ', greatest(40 - length(path), 0)),
  repeat(' ', greatest(4 - length(CAST(coalesce(lines, 0) AS VARCHAR)), 0)) || CAST(coalesce(lines, 0) AS VARCHAR),
  lpad(CASE WHEN delta > 0 THEN '+' || delta WHEN delta < 0 THEN '' || delta ELSE '' END, 6, ' '), CASE WHEN dirty THEN 'dirty' ELSE '' END)"""

_NOT_IGNORED = f"NOT list_has_any(string_split(path, '/'), [{_list(IGNORED)}])"
_NO_ASSET = f"ext <> '' AND lower(ext) NOT IN ({_list(ASSETS)})"
_EXT_BARE = "lower(regexp_replace(ext, '^\\.', ''))"


def _chained(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST({p} AS VARCHAR), '') || ':'" for p in parts) + ")"


def _dirs(where: str = "") -> str:
    return f"""above AS (SELECT root, size, unnest(list_transform(generate_series(0, len(string_split(path, '/')) - 1), lambda n: array_to_string(string_split(path, '/')[:n], '/'))) AS dir FROM f{where}),
d AS (SELECT root, dir, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM above GROUP BY root, dir)"""


_CODE = f"""code0 AS (SELECT *, lower(ext) IN ({_list(CODE_EXTENSIONS)}) OR {_base("path")} IN ({_list(CODE_NAMES)}) AS c FROM f),
code AS (SELECT * FROM code0 WHERE c OR NOT (SELECT bool_or(c) FROM code0)),
byext AS (SELECT CASE WHEN ext <> '' THEN lower(ext) ELSE {_base("path")} END AS ext, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM code GROUP BY 1),
sky AS (SELECT ext, files, bytes, CAST(2 + floor(sqrt((bytes - min(bytes) OVER ()) / greatest(max(bytes) OVER () - min(bytes) OVER (), 1)) * 10) AS INT) AS height FROM byext)"""

_ROUTES = [("watching", ["event", "watcher", "daemon", "watch/"]), ("graph", ["import", "edge", "graph", "graph/"]), ("handoff", ["handoff", "snapshot", "summary", "handoff/"]), ("config", ["config", "budget", "config"]), ("render", ["tree view", "outline", "layout", "render/"])]
_SUBSYSTEMS = " UNION ALL ".join(f"SELECT doc_id AS id, '{s}' AS subsystem, CAST({' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INT)' for w in ws)} AS INT) AS score FROM documents" for s, ws in _ROUTES)

def _extracted(table: dict[str, str]) -> str:
    """The distinct finds of a language's expression, in order, joined by commas."""
    found = " ".join(f"WHEN '{k}' THEN regexp_extract_all(content, '{v.replace(chr(39), chr(39) * 2)}', 1)" for k, v in table.items())
    return f"CASE language {found} ELSE [] END"


_TEXTS = f"""t AS (SELECT f.file_id, {_language("f.path")} AS language, c.content FROM f JOIN (SELECT file_id, max(content) AS content FROM contents WHERE content IS NOT NULL GROUP BY file_id) c USING (file_id)),
x AS (SELECT file_id, language, list_transform({_extracted(IMPORTS)}, lambda i: trim(i)) AS i, list_transform({_extracted(FUNCTIONS)}, lambda i: trim(i)) AS u FROM t WHERE language IS NOT NULL),
y AS (SELECT file_id, language, list_filter(i, lambda v, k: list_position(i, v) = k) AS imports, list_filter(u, lambda v, k: list_position(u, v) = k) AS functions FROM x)"""

_FAMILY = _case({x: FAMILIES.get(x, x) for x in EXTENSIONS.values()}, "language")

_RESOLVE = rf"""langs AS (SELECT *, {_language("path")} AS language FROM f),
known AS (SELECT DISTINCT root, path, {_FAMILY} AS family FROM langs WHERE language IS NOT NULL),
tails AS (SELECT root, path, family, unnest(generate_series(1, len(string_split(path, '/')))) AS i, string_split(path, '/') AS p FROM known),
idx0 AS (SELECT root, family, path, CASE WHEN i = 1 THEN 'exact' ELSE 'suffix' END AS kind, array_to_string(p[i:], '/') AS key FROM tails),
idx AS (SELECT * FROM idx0 UNION SELECT root, family, path, kind, regexp_replace(key, '\.[^./]*$', '') FROM idx0 UNION SELECT root, family, path, 'dir', {_dir("path")} FROM known UNION SELECT root, family, path, 'whole', path FROM known),
before AS (SELECT root, path, file_id, lag(path) OVER (PARTITION BY root, ext ORDER BY file_id) AS prev FROM f WHERE ext <> ''),
specs AS (SELECT DISTINCT root, path AS src, CASE file_id % 5 WHEN 0 THEN replace(regexp_replace(prev, '\.[^./]*$', ''), '/', '.') WHEN 1 THEN regexp_replace(prev, '\.[^./]*$', '')
  WHEN 2 THEN regexp_replace(regexp_replace(prev, '\.[^./]*$', ''), '^[^/]*/', '') WHEN 3 THEN '../../../../../' || regexp_replace(prev, '\.[^./]*$', '') ELSE {_dir("prev")} END AS spec FROM before WHERE prev IS NOT NULL),
one AS (SELECT s.*, {_language("src")} AS language FROM specs s),
fam AS (SELECT *, {_FAMILY} AS family, CASE WHEN contains(spec, '.') AND NOT contains(spec, '/') AND NOT starts_with(spec, '.') THEN replace(spec, '.', '/') ELSE spec END AS norm FROM one WHERE language IS NOT NULL),
tries AS (SELECT root, src, spec, family, 200 AS strategy, 'exact' AS kind, regexp_replace(spec, '^(\.\./)+', '') AS key FROM fam WHERE starts_with(spec, '.')
  UNION ALL SELECT root, src, spec, family, unnest([500, 600, 700]), unnest(['exact', 'suffix', 'dir']), norm FROM fam WHERE NOT starts_with(spec, '.') AND family NOT IN ('go', 'js')),
rungs AS (SELECT DISTINCT root, family, kind, key, unnest(generate_series(0, {len(LADDER) - 1})) AS rung, key || unnest([{_list(LADDER)}]) AS full_key FROM tries WHERE kind <> 'dir' AND key <> ''
  UNION SELECT DISTINCT root, family, kind, key, 0, '__init__.py' FROM tries WHERE kind <> 'dir' AND key = ''
  UNION SELECT DISTINCT root, family, kind, key, unnest(generate_series(0, len(string_split(key, '/')) - 1)), unnest(list_transform(generate_series(1, len(string_split(key, '/'))), lambda i: array_to_string(string_split(key, '/')[i:], '/'))) FROM tries WHERE kind = 'dir'),
hits AS (SELECT r.root, r.family, r.kind, r.key, r.rung, idx.path FROM rungs r JOIN idx ON idx.root = r.root AND idx.family = r.family AND idx.kind = r.kind AND idx.key = r.full_key),
won AS (SELECT * FROM hits QUALIFY rung = min(rung) OVER (PARTITION BY root, family, kind, key)),
resolved AS (SELECT DISTINCT root, src, spec, strategy, path AS dst FROM (SELECT t.*, w.path, min(strategy) OVER (PARTITION BY t.root, t.src, t.spec) AS best FROM tries t JOIN won w USING (root, family, kind, key)) WHERE strategy = best)"""

SQL = {
    "degree_table": f"WITH {_EDGES}, {_DEGREE} SELECT * FROM degree",
    "hub_files": f"WITH {_EDGES}, {_HUBS} SELECT * FROM hubs",
    "hub_files_with_tests": f"WITH {_EDGES} SELECT dst AS path, count(*) AS importers FROM edges GROUP BY dst HAVING count(*) >= 3",
    "hub_files_report": f"WITH {_EDGES} SELECT dst AS path, count(*) AS importers FROM edges WHERE NOT {_test('src')} GROUP BY dst HAVING count(*) >= 3",
    "hub_footer_displayed": f"WITH {_EDGES}, {_CHANGED} SELECT dst AS path, count(*) AS importers FROM edges WHERE src IN (FROM changed) AND dst IN (FROM changed) GROUP BY dst HAVING count(*) >= 2",
    "hub_top3_importers": f"WITH {_EDGES}, {_HUBS} SELECT path, importers, src, CAST(row_number() OVER (PARTITION BY path ORDER BY src) AS INT) AS nth FROM hubs JOIN edges ON dst = path QUALIFY nth <= 3",
    "importers_of": f"""WITH {_EDGES}, {_CHANGED}, {_HUBS}, {_DEGREE}, hi AS (SELECT src AS path, count(*) AS hub_imports FROM edges WHERE dst IN (SELECT path FROM hubs) GROUP BY src)
      SELECT path, coalesce(importers, 0) AS importer_count, least(coalesce(importers, 0), 500) AS shown, coalesce(importers, 0) > 500 AS truncated, greatest(coalesce(importers, 0) - 500, 0) AS omitted,
        coalesce(imports, 0) AS imports, coalesce(hub_imports, 0) AS hub_imports, path IN (SELECT path FROM hubs) AS is_hub FROM changed LEFT JOIN degree USING (path) LEFT JOIN hi USING (path)""",
    "imports_of": f"WITH {_EDGES}, {_CHANGED} SELECT src, dst FROM edges WHERE src IN (FROM changed)",
    "connected_files": f"WITH {_EDGES} SELECT src AS path, dst AS other FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst",
    "hub_imports": f"WITH {_EDGES}, {_HUBS} SELECT src, dst FROM edges WHERE dst IN (SELECT path FROM hubs)",
    "displayed_subgraph": f"WITH {_EDGES}, {_CHANGED} SELECT src, dst FROM edges WHERE src IN (FROM changed) AND dst IN (FROM changed)",
    "changed_files_annotated": f"WITH {_FILES} SELECT file_id, size, ext, is_new, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM f WHERE coalesce(added, 0) + coalesce(removed, 0) > 20",
    "changed_semi": f"WITH {_FILES} SELECT file_id, root, path FROM f WHERE coalesce(added, 0) + coalesce(removed, 0) > 20",
    "impact_by_basename": f"""WITH {_CHANGED}, used AS (SELECT {plain("file", "root")} AS path, unnest(imports) AS spec FROM importers_report),
      k AS (SELECT path, regexp_replace({_base("spec")}, '\\.[^.]*$', '') AS k FROM used WHERE path IS NOT NULL AND spec IS NOT NULL),
      bases AS (SELECT regexp_replace({_base("path")}, '\\.[^.]*$', '') AS k, max(path) AS target FROM changed GROUP BY 1),
      dirs AS (SELECT {_base("d")} AS k, arg_min(d, path) AS target FROM (SELECT path, {_dir("path")} AS d FROM changed) WHERE d <> '' GROUP BY 1),
      hits AS (SELECT target FROM k JOIN bases USING (k) WHERE path <> target UNION ALL SELECT target || '/' FROM k JOIN dirs USING (k) WHERE {_dir("path")} <> target)
      SELECT target, {_base("rtrim(target, '/')")} AS file, count(*) AS used_by FROM hits GROUP BY target""",
    "blast_impacted": f"WITH {_EDGES}, {_CHANGED} SELECT DISTINCT src AS path, dst AS via FROM edges WHERE dst IN (FROM changed) AND src NOT IN (FROM changed)",
    "blast_context": f"""WITH {_EDGES}, {_CHANGED}, {_HUBS} SELECT DISTINCT dst AS path, src AS via, CASE WHEN dst IN (SELECT path FROM hubs) THEN 'shared_hub_dependency' ELSE 'dependency' END AS relation,
      dst IN (SELECT path FROM hubs) AS is_hub FROM edges WHERE src IN (FROM changed) AND dst NOT IN (FROM changed)""",
    "blast_top_impacted": f"""WITH {_EDGES}, {_CHANGED}, {_DEGREE}, i AS (SELECT DISTINCT src AS path, dst AS via FROM edges WHERE dst IN (FROM changed) AND src NOT IN (FROM changed))
      SELECT i.path, via, importers AS via_importers FROM i JOIN degree g ON g.path = via ORDER BY via_importers DESC, i.path, via LIMIT 12""",
    "blast_summary": f"""WITH {_EDGES}, {_CHANGED}, per AS (SELECT path, count(src) AS n FROM changed LEFT JOIN edges ON dst = path GROUP BY path)
      SELECT count(*) AS changed, (SELECT count(DISTINCT src) FROM edges WHERE dst IN (FROM changed) AND src NOT IN (FROM changed)) AS impacted,
        count(*) FILTER (n > 0) AS with_dependents, max(n) AS most_dependents, CASE WHEN max(n) > 0 THEN arg_min(path, (-n, path)) END AS highest FROM per""",
    "risk_files": f"WITH {_EDGES}, {_CHANGED} SELECT dst AS path, count(*) AS importers, count(*) >= 3 AS is_hub FROM edges WHERE dst IN (FROM changed) GROUP BY dst HAVING count(*) >= 2",
    "priority_fill": f"""WITH {_EDGES}, {_CHANGED}, r AS (SELECT dst AS path, count(*) AS n FROM edges WHERE dst IN (FROM changed) GROUP BY dst HAVING count(*) >= 2)
      SELECT path, n IS NOT NULL AS is_risk FROM changed LEFT JOIN r USING (path) ORDER BY n IS NULL, n DESC, path LIMIT 60""",
    "status_rank_merge": f"""WITH c AS (SELECT unnest(delta.changed) AS c FROM handoff_artifact), s AS (SELECT c.path AS path, c.status AS status, list_position([{_list(STATUSES)}], c.status) AS r FROM c)
      SELECT path, arg_max(status, r) AS status FROM s WHERE r > 0 AND path IS NOT NULL GROUP BY path""",
    "tree_dir_rollup": f"WITH {_FILES}, {_dirs()} SELECT root, dir, files, bytes, CAST(depth AS INT) AS depth FROM d",
    "tree_chains": f"""WITH RECURSIVE {_FILES}, {_dirs()}, own AS (SELECT root, {_dir("path")} AS dir, count(*) AS own FROM f GROUP BY 1, 2),
      kids AS (SELECT root, {_dir("dir")} AS up, count(*) AS kids, min(dir) AS kid FROM d WHERE dir <> '' GROUP BY 1, 2),
      one AS (SELECT d.root, d.dir, coalesce(own, 0) = 0 AND coalesce(kids, 0) = 1 AS single, kid FROM d LEFT JOIN own ON own.root = d.root AND own.dir = d.dir LEFT JOIN kids ON kids.root = d.root AND kids.up = d.dir),
      walk(root, top, here) AS (SELECT root, dir, kid FROM one o WHERE single AND NOT EXISTS (SELECT 1 FROM one p WHERE p.root = o.root AND p.single AND p.kid = o.dir)
        UNION ALL SELECT w.root, w.top, o.kid FROM walk w JOIN one o ON o.root = w.root AND o.dir = w.here WHERE o.single)
      SELECT root, top, arg_max(here, length(here)) AS "end" FROM walk GROUP BY root, top""",
    "tree_depth_hidden": f"""WITH {_FILES}, p AS (SELECT root, array_to_string(string_split(path, '/')[:2], '/') AS dir, {_dir("path")} AS under FROM f WHERE len(string_split(path, '/')) > 2)
      SELECT root, dir, count(*) AS hidden_files, count(DISTINCT CASE WHEN under <> dir THEN under END) AS hidden_dirs FROM p GROUP BY root, dir""",
    "dir_homogeneous_ext": f"WITH {_FILES} SELECT root, {_dir('path')} AS dir, count(*) AS files, min(ext) AS ext FROM f GROUP BY 1, 2 HAVING count(*) > 1 AND min(ext) = max(ext)",
    "tree_totals": f"WITH {_FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM f",
    "top_extensions": f"WITH {_FILES} SELECT ext, count(*) AS files FROM f WHERE ext <> '' GROUP BY ext ORDER BY files DESC, ext LIMIT 5",
    "top_large_files": f"WITH {_FILES} SELECT root || '/' || path AS path, size FROM f WHERE size IS NOT NULL AND {_NO_ASSET} ORDER BY size DESC, 1 LIMIT 5",
    "top_large_files_per_root": f"WITH {_FILES} SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY size DESC, path) AS INT) AS nth, path, size FROM f WHERE size IS NOT NULL AND {_NO_ASSET} QUALIFY nth <= 5",
    "ext_aggregate": f"WITH {_FILES} SELECT CASE WHEN ext <> '' THEN lower(ext) ELSE {_base('path')} END AS ext, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM f GROUP BY 1",
    "skyline_heights": f"WITH {_FILES}, {_CODE} SELECT * FROM sky",
    "skyline_arranged": f"""WITH {_FILES}, {_CODE}, n AS (SELECT *, row_number() OVER (ORDER BY height DESC, bytes DESC, ext) - 1 AS nth FROM sky)
      SELECT ext, files, bytes, height, CASE WHEN nth % 2 = 0 THEN CAST(nth / 2 AS DOUBLE) ELSE CAST(-(nth + 1) / 2 AS DOUBLE) END AS place FROM n""",
    "size_human": f"""WITH {_FILES} SELECT file_id, CASE WHEN size < 1024 THEN printf('%.1fB', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN printf('%.1fKB', size / 1024.0)
      WHEN size < 1073741824 THEN printf('%.1fMB', size / 1048576.0) ELSE printf('%.1fGB', size / 1073741824.0) END AS size FROM f WHERE size IS NOT NULL""",
    "filter_scanned": f"WITH {_FILES} SELECT file_id, root, path FROM f WHERE {_NOT_IGNORED}",
    "filter_only_exclude": f"""WITH {_FILES} SELECT file_id, root, path FROM f WHERE {_NOT_IGNORED} AND {_EXT_BARE} IN ('go', 'py', 'ts')
      AND NOT regexp_matches({_base("path")}, '^[^/]*_test[^/]*$') AND NOT contains('/' || path || '/', '/hooks/') AND NOT ends_with(lower(path), '.hooks') AND NOT ends_with(lower(path), '.rb')
      AND NOT contains('/' || path || '/', '/.rb/') AND NOT regexp_matches(path, '^cmd/[^/]*/r[^/]*\\.go$') AND NOT regexp_matches({_base("path")}, '^cmd/[^/]*/r[^/]*\\.go$')""",
    "find_file_split": f"""WITH {_FILES}, q AS (SELECT root || '/' || path AS path, {_EXT_BARE} AS x FROM f)
      SELECT path, x IN ('go', 'py') AS visible FROM q WHERE contains(lower(path), 'store') AND NOT contains('/' || path || '/', '/vendor/') AND NOT ends_with(lower(path), '.vendor') AND (x IN ('go', 'py') OR x <> 'c')""",
    "lang_histogram": f"WITH {_FILES} SELECT {_language('path')} AS language, count(*) AS files FROM f WHERE {_language('path')} IS NOT NULL GROUP BY 1",
    "primary_language": f"WITH {_FILES}, n AS (SELECT root, {_language('path')} AS language, count(*) AS files FROM f GROUP BY 1, 2) SELECT root, language, files FROM n WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root ORDER BY files DESC, language) = 1",
    "adaptive_limits": f"""WITH {_FILES}, n AS (SELECT root, count(*) AS files FROM f GROUP BY root) SELECT root, files, CASE WHEN files > 5000 THEN 2 WHEN files > 2000 THEN 3 ELSE 4 END AS depth,
      CASE WHEN files > 5000 THEN 25 WHEN files > 2000 THEN 40 ELSE 60 END AS changed, CASE WHEN files > 5000 THEN 8 WHEN files > 2000 THEN 10 ELSE 15 END AS risk, CASE WHEN files > 5000 THEN 10 WHEN files > 2000 THEN 15 ELSE 25 END AS events FROM n""",
    "systems": f"""WITH {_FILES}, n AS (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^[^/]*') ELSE '.' END AS system, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM f GROUP BY 1),
      w AS (SELECT *, list_filter(string_split(replace(replace(system, '_', ' '), '-', ' '), ' '), lambda x: x <> '') AS ws FROM n)
      SELECT system, files, bytes, array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), ' ') AS name FROM w""",
    "test_files": f"WITH {_FILES} SELECT file_id, path FROM f WHERE {_test('path')}",
    "activity_by_file": f"WITH {_EVENTS} SELECT root, path, count(*) AS edits, CAST(coalesce(sum(delta), 0) AS BIGINT) AS net_delta, max(ts) AS last_edit, coalesce(bool_or(dirty), false) AS dirty FROM e WHERE op IN ('CREATE', 'WRITE') GROUP BY root, path",
    "activity_recent": f"WITH {_EVENTS} SELECT root, path, count(*) AS edits, CAST(coalesce(sum(delta), 0) AS BIGINT) AS net_delta, max(ts) AS last_edit, coalesce(bool_or(dirty), false) AS dirty FROM e WHERE op IN ('CREATE', 'WRITE') AND ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY root, path",
    "activity_summary": f"""WITH {_EVENTS}, p AS (SELECT root, path, count(*) AS n, coalesce(sum(delta), 0) AS d, coalesce(bool_or(dirty), false) AS u FROM e WHERE op IN ('CREATE', 'WRITE') GROUP BY root, path)
      SELECT root, count(*) AS files, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(d) AS BIGINT) AS net_delta, count(*) FILTER (u) AS uncommitted FROM p GROUP BY root""",
    "session_summary_all_ops": f"""WITH {_EVENTS}, p AS (SELECT root, path, count(*) AS n, coalesce(sum(delta), 0) AS d, coalesce(bool_or(dirty), false) AS u FROM e GROUP BY root, path)
      SELECT root, count(*) AS files, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(d) AS BIGINT) AS net_delta, count(*) FILTER (u) AS uncommitted FROM p GROUP BY root""",
    "timeline_last_n": f"WITH {_EVENTS} SELECT event_id, ts, op, path FROM e ORDER BY ts DESC, path DESC, op DESC, event_id DESC LIMIT 50",
    "bounded_history": f"WITH {_EVENTS} SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY ts DESC, event_id DESC) AS INT) AS nth, event_id, ts, op, path FROM e QUALIFY nth <= 50",
    "working_set": f"WITH {_EVENTS}, {_WORKING} SELECT * FROM working",
    "hot_files": f"WITH {_EVENTS}, {_WORKING} SELECT * FROM working ORDER BY edits DESC, last_touch DESC, root, path LIMIT 20",
    "active_files": f"WITH {_EVENTS}, {_WORKING} SELECT * FROM working WHERE last_touch >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY",
    "working_set_hubs": f"WITH {_EVENTS}, {_WORKING}, {_COUNTS} SELECT root, count(*) AS files, count(*) FILTER (coalesce(importers, 0) >= 3) AS hubs FROM working LEFT JOIN counts USING (path) GROUP BY root",
    "debounce_batch": f"""WITH {_EVENTS}, n AS (SELECT root, path, event_id, ts, op = 'WRITE' AND coalesce(lag(op) OVER w = 'WRITE', false) AND ts - lag(ts) OVER w < INTERVAL 2 SECOND AS skipped,
        coalesce(lead(op) OVER w = 'WRITE' AND lead(ts) OVER w - ts < INTERVAL 2 SECOND, false) AS more FROM e WINDOW w AS (PARTITION BY root, path ORDER BY ts, event_id))
      SELECT root, path, event_id, ts, coalesce(skipped, false) AS skipped, coalesce(skipped, false) AND NOT more AS last_of_burst FROM n""",
    "unchanged_writes": f"WITH {_EVENTS} SELECT root, path, event_id FROM e WINDOW w AS (PARTITION BY root, path ORDER BY ts, event_id) QUALIFY op = 'WRITE' AND size // 20000 = lag(size // 20000) OVER w AND lines // 200 = lag(lines // 200) OVER w",
    "stateful_delta": f"""WITH {_EVENTS}, s AS (SELECT *, CASE WHEN op IN ('REMOVE', 'RENAME') THEN 0 WHEN lines IS NOT NULL OR size IS NOT NULL THEN coalesce(lines, 0) END AS l,
        CASE WHEN op IN ('REMOVE', 'RENAME') THEN 0 WHEN lines IS NOT NULL OR size IS NOT NULL THEN coalesce(size, 0) END AS z FROM e)
      SELECT root, path, event_id, CAST(CASE WHEN l IS NULL THEN 0 ELSE l - coalesce(last_value(l IGNORE NULLS) OVER w, 0) END AS BIGINT) AS line_delta,
        CAST(CASE WHEN z IS NULL THEN 0 ELSE z - coalesce(last_value(z IGNORE NULLS) OVER w, 0) END AS BIGINT) AS size_delta
      FROM s WINDOW w AS (PARTITION BY root, path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "related_hot": f"""WITH {_EVENTS}, p AS (SELECT DISTINCT root, {_dir("path")} AS dir, path FROM e), n AS (SELECT root, path, lag(path) OVER (PARTITION BY root, dir ORDER BY path) AS other FROM p),
      near AS (SELECT * FROM n WHERE other IS NOT NULL UNION SELECT root, other, path FROM n WHERE other IS NOT NULL)
      SELECT DISTINCT a.event_id, c.other FROM e a JOIN near c ON c.root = a.root AND c.path = a.path JOIN e b ON b.root = c.root AND b.path = c.other
      WHERE b.op IN ('CREATE', 'WRITE') AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 5 MINUTE""",
    "event_enrichment": f"WITH {_EVENTS}, {_EDGES}, {_DEGREE} SELECT event_id, coalesce(importers, 0) AS importers, coalesce(imports, 0) AS imports, coalesce(importers, 0) >= 3 AS is_hub FROM e LEFT JOIN degree USING (path)",
    "control_sessions": f"""WITH {_EVENTS}, m AS (SELECT root, ts, op, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 SECOND THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY root ORDER BY ts)),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts) AS s FROM m) SELECT root, min(ts) AS began, count(*) AS events, bool_or(op = 'REMOVE') AS removed FROM n GROUP BY root, s""",
    "event_log_lines": f"WITH {_EVENTS} SELECT event_id, {_LINE} AS line FROM e",
    "log_byte_trim": f"WITH {_EVENTS}, l AS (SELECT root, event_id, sum(octet_length(encode({_LINE})) + 1) OVER (PARTITION BY root ORDER BY ts DESC, event_id DESC) AS total FROM e) SELECT root, event_id FROM l WHERE total <= 16384",
    "last_operation": f"""WITH {_EVENTS}, {_FILES}, o AS (SELECT root, path, arg_max(op, (ts, event_id)) AS op FROM e GROUP BY root, path)
      SELECT root, path, CASE WHEN op IN ('REMOVE', 'RENAME') AND (root, path) IN (SELECT (root, path) FROM f) THEN 'EDITED' ELSE op END AS op FROM o""",
    "event_gaps": f"WITH {_EVENTS} SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY root ORDER BY ts, event_id)) AS gap_us FROM e",
    "intent_scores": f"WITH {_SCORES} SELECT id, category, score FROM scores WHERE score > 0",
    "intent_category": f"WITH {_INTENT} SELECT * FROM intent",
    "extract_mentions": f"WITH {_MENTIONS} SELECT id, CAST(unnest(generate_series(1, len(found))) - 1 AS INT) AS pos, unnest(found) AS mention FROM distinct_mentions",
    "task_scope": f"WITH {_MENTIONS}, {_NAMED} SELECT id, CASE WHEN count(DISTINCT path) = 0 THEN 'unknown' WHEN count(DISTINCT path) = 1 THEN 'single-file' WHEN count(DISTINCT {_dir('path')}) <= 1 THEN 'package' ELSE 'cross-cutting' END AS scope FROM named GROUP BY id",
    "task_risk": f"""WITH {_MENTIONS}, {_NAMED}, {_EVENTS}, {_COUNTS}, t AS (SELECT id, count(path) AS files, count(*) FILTER (coalesce(importers, 0) >= 3) AS hubs, coalesce(max(importers), 0) AS most FROM named LEFT JOIN counts USING (path) GROUP BY id)
      SELECT id, hubs, most, CASE WHEN files = 0 THEN 'unknown' WHEN hubs >= 2 OR most >= 8 THEN 'high' WHEN hubs > 0 THEN 'medium' ELSE 'low' END AS risk FROM t""",
    "task_suggestions": f"""WITH {_MENTIONS}, {_NAMED}, {_EVENTS}, {_COUNTS}, {_INTENT}, o AS (SELECT n.id, pos, n.path, coalesce(importers, 0) >= 3 AS hub, category FROM named n LEFT JOIN counts USING (path) JOIN intent i ON i.id = n.id WHERE n.path IS NOT NULL),
      r AS (SELECT id, pos, 0 AS o, 'review-hub' AS kind, path AS target FROM o WHERE hub UNION ALL SELECT id, pos, 1, 'check-deps', path FROM o WHERE hub AND category IN ('refactor', 'feature')
        UNION ALL SELECT id, 1000000, 2, 'run-tests', CASE WHEN any_value(category) = 'refactor' OR NOT contains(arg_min(path, pos), '/') THEN '.' ELSE regexp_replace(arg_min(path, pos), '/[^/]*$', '') END FROM o WHERE category IN ('bugfix', 'refactor') GROUP BY id)
      SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos, o) AS INT) AS nth, kind, target FROM r QUALIFY nth <= 5""",
    "route_topk": f"WITH s AS ({_SUBSYSTEMS}) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, subsystem) AS INT) AS nth, subsystem, score FROM s WHERE score > 0 QUALIFY nth <= 3",
    "truncate_line_boundary": """WITH c AS (SELECT doc_id AS id, text, CASE WHEN octet_length(encode(text)) > 600 THEN left(text, list_max(list_filter(generate_series(0, 600), lambda n: octet_length(encode(left(text, n))) <= 600))) END AS kept FROM documents),
      t AS (SELECT *, regexp_extract(kept, '\\n[^\\n]*$') AS tail FROM c)
      SELECT id, md5(CASE WHEN kept IS NULL THEN text WHEN tail <> '' AND octet_length(encode(kept)) - octet_length(encode(tail)) > 0 THEN left(kept, length(kept) - length(tail)) || E'\\n\\n... (truncated)\\n' ELSE kept || E'\\n\\n... (truncated)\\n' END) AS text FROM t""",
    "truncate_letters": "SELECT doc_id AS id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS text FROM documents",
    "line_counts": "SELECT doc_id AS id, CAST(len(string_split(text, E'\\n')) AS INT) AS lines FROM documents",
    "excerpts": """WITH c AS (SELECT file_id, string_split(max(content), E'\\n') AS l FROM contents WHERE content IS NOT NULL GROUP BY file_id)
      SELECT file_id, array_to_string(list_transform(generate_series(1, least(5, len(l))), lambda n: lpad(CAST(n AS VARCHAR), 4, ' ') || ' | ' || l[n]), E'\\n') AS excerpt FROM c""",
    "coverage_reduce": """SELECT root, CASE WHEN count(coverage_status) > 0 AND bool_and(coverage_status = 'complete') THEN 'complete' WHEN bool_or(coverage_status IN ('complete', 'partial')) THEN 'partial' ELSE 'unavailable' END AS status FROM importers_report GROUP BY root""",
    "handoff_hash": f"WITH {_FILES} SELECT file_id, {_chained('root', 'path', 'size')} AS hash FROM f",
    "handoff_listed": f"""WITH {_FILES} SELECT file_id FROM f WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.arborlens', 'node_modules', 'vendor', 'dist', 'build', 'target', '__pycache__', '.next', '.nuxt'])
      AND NOT lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ({_list(BINARY)})""",
    "cache_metrics": f"""WITH a AS (SELECT DISTINCT root, artifact_id, written_at, CAST(coalesce(prefix.file_count, 0) AS BIGINT) AS fc, CAST(coalesce(len(delta.changed), 0) AS BIGINT) AS n, branch FROM handoff_artifact),
      m AS (SELECT *, coalesce({_chained("branch")} = lag({_chained("branch")}) OVER w, false) AS prefix_reused, coalesce(n = lag(n) OVER w, false) AS delta_reused FROM a WINDOW w AS (PARTITION BY root ORDER BY written_at, artifact_id)),
      r AS (SELECT *, CASE WHEN prefix_reused THEN fc ELSE 0 END + CASE WHEN delta_reused THEN n ELSE 0 END AS reused FROM m)
      SELECT root, artifact_id, fc + n AS bytes, CAST(reused AS BIGINT) AS reused_bytes, prefix_reused, delta_reused, CASE WHEN fc + n > 0 THEN reused / (fc + n) ELSE 0.0 END AS ratio FROM r""",
    "extract_code": f"WITH {_FILES}, {_TEXTS} SELECT file_id, language, array_to_string(imports, ',') AS imports, array_to_string(functions, ',') AS functions FROM y",
    "function_counts": f"WITH {_FILES}, {_TEXTS} SELECT language, count(*) AS files, CAST(sum(len(functions)) AS BIGINT) AS functions FROM y GROUP BY language",
    "resolve_ladder": f"WITH {_FILES}, {_RESOLVE} SELECT * FROM resolved",
    "resolve_degree": f"""WITH {_FILES}, {_RESOLVE}, edges AS (SELECT DISTINCT root || '/' || src AS src, root || '/' || dst AS dst FROM resolved), {_DEGREE} SELECT * FROM degree""",
    "file_index_keys": f"WITH {_FILES}, {_RESOLVE} SELECT kind, family, count(*) AS keys, count(DISTINCT key) AS distinct_keys FROM idx GROUP BY kind, family",
    "task_next_steps": f"""WITH {_MENTIONS}, {_NAMED}, {_EVENTS}, {_COUNTS}, {_INTENT},
      top AS (SELECT id, arg_max(path, (coalesce(importers, 0), -pos)) AS path, max(coalesce(importers, 0)) AS n FROM named LEFT JOIN counts USING (path) WHERE path IS NOT NULL GROUP BY id),
      o AS (SELECT i.id, category, path, coalesce(n >= 3, false) AS hub FROM intent i LEFT JOIN top USING (id) WHERE sure),
      s AS (SELECT id, list_filter([CASE WHEN path IS NOT NULL THEN 'importers of ' || path END, CASE WHEN hub THEN 'dependencies' END, CASE WHEN category = 'vcs' THEN 'change' END,
        CASE WHEN category = 'explore' THEN CASE WHEN path IS NULL THEN 'structure' ELSE 'dependencies' END END, CASE WHEN category = 'refactor' THEN 'dependencies' END,
        CASE WHEN category = 'feature' AND path IS NULL THEN 'structure' END, CASE WHEN category = 'feature' THEN 'dependencies' END,
        CASE WHEN category = 'bugfix' THEN CASE WHEN path IS NULL THEN 'change' WHEN hub THEN 'dependencies' END END], lambda x: x IS NOT NULL) AS l FROM o),
      u AS (SELECT id, list_filter(l, lambda x, k: list_position(l, x) = k)[:2] AS l FROM s)
      SELECT id, CAST(unnest(generate_series(1, len(l))) AS INT) AS nth, unnest(l) AS step FROM u""",
    "coverage_fold": """WITH r AS (SELECT DISTINCT root, report_id, CASE coverage_status WHEN 'complete' THEN 'authoritative' WHEN 'partial' THEN 'mixed' ELSE 'timeout' END AS status FROM importers_report WHERE coverage_status IS NOT NULL),
      n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY report_id, status) AS nth FROM r), l AS (SELECT root, list(status ORDER BY nth) AS l FROM n GROUP BY root)
      SELECT root, split_part(list_reduce(list_prepend('|', list_transform(l, lambda x: x)), lambda s, x: CASE
        WHEN x = 'authoritative' THEN CASE WHEN split_part(s, '|', 1) = 'unavailable' THEN 'partial' ELSE split_part(s, '|', 1) END || '|u' WHEN x = 'mixed' THEN 'partial|u'
        WHEN split_part(s, '|', 2) = 'u' THEN 'partial|u' ELSE 'unavailable|' END), '|', 1) AS status FROM l""",
    "handoff_guidance": """WITH a AS (SELECT artifact_id, max(coalesce(len(delta.changed), 0)) AS c, max(coalesce(len(delta.risk_files), 0)) AS r, max(coalesce(len(delta.recent_events), 0)) AS e, bool_or(delta IS NOT NULL) AS s, bool_or(prefix IS NOT NULL) AS g FROM handoff_artifact GROUP BY artifact_id)
      SELECT artifact_id, array_to_string(list_filter([CASE WHEN r > 0 THEN 'review dependents of files at risk' END, CASE WHEN c > 0 THEN 'run tests of changed files' END], lambda x: x IS NOT NULL), '; ') AS next_steps,
        array_to_string(list_filter([CASE WHEN c = 0 THEN 'no changes found: are base and branch right?' END, CASE WHEN NOT s THEN 'no live state: events may be missing' END, CASE WHEN NOT g THEN 'no import graph: files at risk may be missing' END,
          CASE WHEN e = 0 AND s THEN 'no recent events' END], lambda x: x IS NOT NULL), '; ') AS open_questions FROM a""",
    "doc_drift": """WITH newest AS (SELECT written_at, delta.changed AS changed FROM handoff_artifact WHERE written_at IN (SELECT DISTINCT written_at FROM handoff_artifact WHERE written_at IS NOT NULL ORDER BY written_at DESC LIMIT 200)),
      touched AS (SELECT DISTINCT written_at, c.path AS path FROM (SELECT written_at, unnest(changed) AS c FROM newest) WHERE c.path IS NOT NULL),
      pos AS (SELECT written_at, row_number() OVER (ORDER BY written_at DESC) - 1 AS pos FROM (SELECT DISTINCT written_at FROM newest)),
      dirs AS (SELECT pos, path AS p FROM touched JOIN pos USING (written_at) UNION ALL
        SELECT pos, unnest(list_transform(generate_series(1, len(string_split(path, '/')) - 1), lambda n: array_to_string(string_split(path, '/')[:n], '/') || '/')) FROM touched JOIN pos USING (written_at)),
      place AS (SELECT p, min(pos) AS pos FROM dirs WHERE pos < 200 GROUP BY p),
      pairs AS (SELECT a AS subsystem, a || '/' || b AS doc, CASE WHEN c = '' THEN a || '/' ELSE c END AS code FROM (VALUES ('core'), ('pkg'), ('lib')) x(a), (VALUES ('auth/', 'src/'), ('render/', 'app/'), ('none/', 'cmd/'), ('store/', '')) y(b, c))
      SELECT subsystem, doc, code, CAST(coalesce(d.pos - c.pos, 200) AS INT) AS behind FROM pairs JOIN place c ON c.p = code LEFT JOIN place d ON d.p = doc WHERE d.pos IS NULL OR c.pos < d.pos""",
    "snippet_terms": f"""WITH {_FILES}, c AS (SELECT file_id, string_split(max(content), E'\\n') AS l FROM contents WHERE content IS NOT NULL GROUP BY file_id),
      k AS (SELECT file_id, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line FROM c), s AS (SELECT file_id, regexp_replace({_base("path")}, '\\.[^.]*$', '') AS stem FROM f),
      t AS (SELECT file_id, 0 AS r, stem AS term FROM s WHERE stem <> '' UNION ALL SELECT file_id, 1, regexp_extract(stem, '^[A-Za-z]+') FROM s WHERE regexp_extract(stem, '^[A-Za-z]+') <> ''),
      h AS (SELECT file_id, r, line_no, line FROM t JOIN k USING (file_id) WHERE CASE WHEN r = 0 THEN regexp_matches(line, '\\b' || regexp_replace(term, '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '\\b') ELSE contains(line, term) END)
      SELECT file_id AS seq, file_id AS path, file_id AS via, CAST(arg_min(line_no, (r, line_no)) AS INT) AS line_no, arg_min(line, (r, line_no)) AS line FROM h GROUP BY file_id""",
}
