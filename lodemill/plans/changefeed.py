"""Queries over the change feed of workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.operators.changefeed import apply_changes
from lodemill.session import table


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(table(spark, sf_dir, "resources"), table(spark, sf_dir, "workspace_events"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_state(spark, sf_dir).where(F.col("status") == "current").select("resource_id", "current_path")


_STATE = """
WITH base AS (
  SELECT id AS resource_id, status, current_path, coalesce(last_sequence, -1) AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_sequence DESC NULLS LAST, updated_at DESC NULLS LAST, state_version DESC NULLS LAST) AS rn
    FROM resources WHERE id IS NOT NULL) WHERE rn = 1),
ev AS (
  SELECT resource_id, sequence AS seq, max(kind) AS kind, max(nullif(detail['path'], '')) AS path
  FROM workspace_events
  WHERE resource_id IS NOT NULL AND sequence IS NOT NULL AND kind IN
    ('resource_created','resource_updated','resource_moved','external_change','resource_ambiguous','resource_deleted')
  GROUP BY workspace_id, sequence, resource_id),
live AS (
  SELECT ev.* FROM ev LEFT JOIN base USING (resource_id) WHERE base.seq IS NULL OR ev.seq > base.seq),
state AS (
  SELECT resource_id, arg_max(kind, seq) AS kind FROM live GROUP BY resource_id),
paths AS (
  SELECT resource_id, arg_max(CASE WHEN kind = 'resource_deleted' THEN '' ELSE path END, seq) AS path
  FROM live WHERE path IS NOT NULL OR kind = 'resource_deleted' GROUP BY resource_id)
SELECT coalesce(state.resource_id, base.resource_id) AS resource_id,
  CASE WHEN state.kind IS NULL THEN base.status WHEN state.kind = 'resource_deleted' THEN 'deleted'
       WHEN state.kind = 'resource_ambiguous' THEN 'ambiguous' ELSE 'current' END AS status,
  CASE WHEN paths.resource_id IS NOT NULL THEN nullif(paths.path, '') ELSE base.current_path END AS current_path
FROM state FULL OUTER JOIN base ON state.resource_id = base.resource_id
LEFT JOIN paths ON paths.resource_id = coalesce(state.resource_id, base.resource_id)
"""

QUERIES = {"p5_found": p5_found, "p5_state": p5_state}
SQL = {
    "p5_state": _STATE,
    "p5_found": f"SELECT resource_id, current_path FROM ({_STATE}) WHERE status = 'current'",
}
