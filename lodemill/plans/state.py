"""Workspace state, event logs, budgets and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.text import estimate_tokens, json_bytes
from lodemill.operators import budget, events, intervals, records
from lodemill.plans import changefeed
from lodemill.session import table

_HOUR = 3_600_000


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once: rows with equal workspace and sequence are one; the least id tells it."""
    rows = table(spark, sf_dir, "workspace_events")
    return rows.groupBy("workspace_id", "sequence").agg(F.min(F.struct("id", "kind", "resource_id", "occurred_at", "correlation_id")).alias("e")).select("workspace_id", "sequence", "e.*")


def event_next_sequence(spark, sf_dir) -> DataFrame:
    return events.next_sequence(table(spark, sf_dir, "workspace_events"))


def event_gaps(spark, sf_dir) -> DataFrame:
    return events.gaps(table(spark, sf_dir, "workspace_events"))


def event_recent(spark, sf_dir) -> DataFrame:
    return events.recent(_log(spark, sf_dir), 10).select("workspace_id", "sequence", "id", "kind", "place")


def event_page(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "workspace_events").agg(F.min("workspace_id")).first()[0]
    return events.page(_log(spark, sf_dir), first, 5, 25).select("workspace_id", "sequence", "id", "kind")


def event_external_changes(spark, sf_dir) -> DataFrame:
    return events.external_changes(table(spark, sf_dir, "workspace_events"))


def event_kinds(spark, sf_dir) -> DataFrame:
    return _log(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("workspace_id").alias("workspaces"), F.count_if(F.col("resource_id").isNull()).alias("without_resource"))


def _outbox(spark, sf_dir) -> DataFrame:
    return _log(spark, sf_dir).select(F.col("kind").alias("projection"), "workspace_id", F.col("sequence").alias("id"), "occurred_at")


def _offsets(spark, sf_dir) -> DataFrame:
    done = _outbox(spark, sf_dir).where(F.col("occurred_at") < F.lit("2025-06-01").cast("timestamp"))
    return done.groupBy("projection", "workspace_id").agg(F.max("id").alias("applied"))


def projection_freshness(spark, sf_dir) -> DataFrame:
    return events.freshness(_outbox(spark, sf_dir), _offsets(spark, sf_dir))


def projection_batch(spark, sf_dir) -> DataFrame:
    return events.delivery_batch(_outbox(spark, sf_dir), _offsets(spark, sf_dir), 5)


def projection_workspaces(spark, sf_dir) -> DataFrame:
    return _outbox(spark, sf_dir).select("workspace_id").union(_offsets(spark, sf_dir).select("workspace_id")).distinct()


def metric_summary(spark, sf_dir) -> DataFrame:
    s = events.metric_summary(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id")
    return s.select("name", "count", *[F.round(c, 4).alias(c) for c in ("total", "least", "highest", "last", "average")])


def metric_rate(spark, sf_dir) -> DataFrame:
    """Purchases over purchases and errors of each user, as hits over hits and misses."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return g.select("user_id", "hits", "misses", F.round(events.rate(F.col("hits"), F.col("hits") + F.col("misses")), 6).alias("rate"))


def metric_outcomes(spark, sf_dir) -> DataFrame:
    outcome = F.when(F.col("value") >= 50, "success").otherwise("failure")
    return table(spark, sf_dir, "events").groupBy(F.concat_ws("_", "event_type", outcome).alias("outcome")).agg(F.count("*").alias("events"))


def resource_latest(spark, sf_dir) -> DataFrame:
    return events.latest_per_key(table(spark, sf_dir, "resources"), "id", ["last_sequence", "state_version"], ["status", "current_path", "workspace_id"])


def resource_counts(spark, sf_dir) -> DataFrame:
    latest = events.latest_per_key(table(spark, sf_dir, "resources"), "id", ["last_sequence", "state_version"], ["status", "workspace_id"])
    return latest.groupBy("workspace_id").agg(F.count("*").alias("resources"), F.count_if(F.col("status") == "current").alias("current"), F.max("last_sequence").alias("last_sequence"))


def resource_affected(spark, sf_dir) -> DataFrame:
    """Resources on record that an external change touches."""
    changed = table(spark, sf_dir, "workspace_events").where(F.col("kind") == "external_change").select("resource_id").where(F.col("resource_id").isNotNull())
    citing = table(spark, sf_dir, "resources").select("id", F.col("id").alias("resource_id")).distinct()
    return events.affected(changed, citing).select("id")


def resource_reconcile(spark, sf_dir) -> DataFrame:
    """Paths that are current in the feed's state against those on record: created, updated, deleted."""
    disk = changefeed.p5_found(spark, sf_dir).where(F.col("current_path").isNotNull()).groupBy(F.col("current_path").alias("path")).agg(F.max("resource_id").alias("content_hash"))
    latest = events.latest_per_key(table(spark, sf_dir, "resources"), "id", ["last_sequence", "state_version"], ["status", "current_path"])
    tracked = latest.where((F.col("status") == "current") & F.col("current_path").isNotNull()).groupBy(F.col("current_path").alias("path")).agg(F.max("id").alias("content_hash"))
    return records.reconcile(disk, tracked)


def _lease_time():
    return F.lit("1998-07-20").cast("timestamp")


def _lease_conflicts(spark, sf_dir, asked) -> DataFrame:
    now = _lease_time()
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("scope"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    leases = orders.where(F.col("o_orderdate") <= now).select(F.col("o_orderkey").alias("lease_id"), "scope", F.lit("active").alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 14).cast("timestamp").alias("expires_at"))
    wanted = orders.where(asked).select(F.col("o_orderkey").alias("request_id"), F.col("scope").alias("paths"))
    return events.lease_conflicts(leases, wanted, now).select("request_id", "lease_id", F.array_join("paths", ",").alias("paths"))


def lease_conflicts(spark, sf_dir) -> DataFrame:
    """Orders hold leases on their parts for fourteen days; the orders of the month after ask for theirs, as in the SQL."""
    return _lease_conflicts(spark, sf_dir, (F.col("o_orderdate") > _lease_time()) & (F.col("o_orderdate") <= F.lit("1998-08-20").cast("timestamp")))


def lease_conflicts_all(spark, sf_dir) -> DataFrame:
    """The same leases against all orders from their day on, without an end."""
    return _lease_conflicts(spark, sf_dir, F.col("o_orderdate") >= _lease_time())


def _brief_items(spark, sf_dir) -> DataFrame:
    """The forty newest events of each workspace as items of a brief: moves before changes before the rest."""
    recent = events.recent(_log(spark, sf_dir), 40)
    payload = F.to_json(F.struct("id", "kind", "resource_id", "sequence"), {"ignoreNullFields": "false"})
    priority = F.when(F.col("kind") == "resource_moved", 10).when(F.col("kind") == "resource_updated", 70).otherwise(90)
    return recent.select("workspace_id", F.col("id").alias("key"), F.col("kind").alias("section"), priority.alias("priority"), F.col("place").alias("ord"), json_bytes(payload).alias("cost"))


def brief_fit(spark, sf_dir) -> DataFrame:
    return budget.first_fit(_brief_items(spark, sf_dir), "workspace_id", 3000)


def brief_omitted(spark, sf_dir) -> DataFrame:
    return budget.omitted_by_section(brief_fit(spark, sf_dir), "workspace_id")


def packed_chunks(spark, sf_dir) -> DataFrame:
    once = table(spark, sf_dir, "chunks").where(F.col("file_id").isNotNull()).groupBy("file_id", "ordinal").agg(F.max(estimate_tokens(F.col("text"))).alias("cost"))
    return budget.pack_consecutive(once, "file_id", "ordinal", "cost", 512)


def _marks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _segments(spark, sf_dir) -> DataFrame:
    return _marks(spark, sf_dir).select("user_id", F.col("ms").alias("start_ms"), (F.col("ms") + _HOUR).alias("end_ms"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"))


def interval_speakers(spark, sf_dir) -> DataFrame:
    speakers = _marks(spark, sf_dir).where(F.col("event_type") == "view").select("user_id", (F.col("ms") - 2 * _HOUR).alias("start_ms"), (F.col("ms") + 2 * _HOUR).alias("end_ms"), F.col("event_id").alias("label"), F.col("event_id").alias("ordinal"))
    return intervals.label_by_overlap(_segments(spark, sf_dir).select("user_id", "start_ms", "end_ms"), speakers, "user_id", 4 * _HOUR)


def interval_scene_texts(spark, sf_dir) -> DataFrame:
    scenes = _marks(spark, sf_dir).where(F.col("event_type") == "click").select("user_id", F.col("ms").alias("start_ms"), (F.col("ms") + 12 * _HOUR).alias("end_ms")).distinct()
    return intervals.texts_in(scenes, _segments(spark, sf_dir), "user_id", 12 * _HOUR)


def _boundaries(spark, sf_dir) -> DataFrame:
    marks = _marks(spark, sf_dir).where(F.col("event_type") == "signup")
    spans = marks.groupBy("user_id").agg(F.min("ms").alias("first"), (F.max("ms") - F.min("ms")).alias("duration"))
    inside = marks.join(spans, "user_id").select("user_id", (F.col("ms") - F.col("first")).alias("boundary"))
    return intervals.filled_boundaries(inside, spans.select("user_id", "duration"), "user_id", 12 * _HOUR)


def interval_boundaries(spark, sf_dir) -> DataFrame:
    return _boundaries(spark, sf_dir)


def interval_scenes(spark, sf_dir) -> DataFrame:
    return intervals.scenes(_boundaries(spark, sf_dir), "user_id")


def interval_spread(spark, sf_dir) -> DataFrame:
    return intervals.spread(intervals.scenes(_boundaries(spark, sf_dir), "user_id"), "user_id", "start_ms", 7)


QUERIES = {f.__name__: f for f in (event_next_sequence, event_gaps, event_recent, event_page, event_external_changes, event_kinds, projection_freshness, projection_batch, projection_workspaces, metric_summary, metric_rate, metric_outcomes, resource_latest, resource_counts, resource_affected, resource_reconcile, lease_conflicts, lease_conflicts_all, brief_fit, brief_omitted, packed_chunks, interval_speakers, interval_scene_texts, interval_boundaries, interval_scenes, interval_spread)}

_LOG = "log AS (SELECT workspace_id, sequence, min(id) AS id, arg_min(kind, id) AS kind, arg_min(resource_id, id) AS resource_id, arg_min(occurred_at, id) AS occurred_at FROM workspace_events GROUP BY 1, 2)"
_OUT = f"{_LOG}, outbox AS (SELECT kind AS projection, workspace_id, sequence AS id, occurred_at FROM log), offsets AS (SELECT projection, workspace_id, max(id) AS applied FROM outbox WHERE occurred_at < timestamptz '2025-06-01 00:00:00+00' GROUP BY 1, 2)"
_LATEST = "latest AS (SELECT * FROM resources WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_sequence DESC NULLS LAST, state_version DESC NULLS LAST, status DESC NULLS LAST, current_path DESC NULLS LAST, workspace_id DESC NULLS LAST) = 1)"
_BRIEF = f"""{_LOG}, recent AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY sequence DESC, id) AS place FROM log QUALIFY place <= 40),
items AS (SELECT workspace_id, id AS key, kind AS section, CASE kind WHEN 'resource_moved' THEN 10 WHEN 'resource_updated' THEN 70 ELSE 90 END AS priority, place,
  length('{{"id":"' || id || '","kind":"' || kind || '","resource_id":' || coalesce('"' || resource_id || '"', 'null') || ',"sequence":' || sequence || '}}') AS cost FROM recent),
numbered AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY priority, place, key) AS n FROM items),
walk AS (
  SELECT workspace_id, n, key, section, cost, cost <= 3000 AS included, CASE WHEN cost <= 3000 THEN cost ELSE 0 END AS used FROM numbered WHERE n = 1
  UNION ALL SELECT i.workspace_id, i.n, i.key, i.section, i.cost, i.cost <= 3000 - w.used, w.used + CASE WHEN i.cost <= 3000 - w.used THEN i.cost ELSE 0 END
  FROM walk w JOIN numbered i ON i.workspace_id = w.workspace_id AND i.n = w.n + 1)"""
_MARKS = "marks AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), segments AS (SELECT user_id, ms AS start_ms, ms + 3600000 AS end_ms, event_id AS ord, event_type AS text FROM marks)"
_BOUNDS = f"""{_MARKS}, spans AS (SELECT user_id, min(ms) AS first, max(ms) - min(ms) AS duration FROM marks WHERE event_type = 'signup' GROUP BY 1),
known AS (SELECT user_id, ms - first AS boundary FROM marks JOIN spans USING (user_id) WHERE event_type = 'signup' UNION SELECT user_id, 0 FROM spans UNION SELECT user_id, greatest(duration, 0) FROM spans),
laid AS (SELECT user_id, boundary, lag(boundary) OVER (PARTITION BY user_id ORDER BY boundary) AS before FROM known),
bounds AS (SELECT user_id, boundary FROM laid UNION SELECT user_id, b FROM (SELECT user_id, boundary, unnest(generate_series(before + 43200000, boundary, 43200000)) AS b FROM laid WHERE boundary - before > 43200000) WHERE b < boundary),
scenes AS (SELECT user_id, boundary AS start_ms, lead(boundary) OVER (PARTITION BY user_id ORDER BY boundary) AS end_ms FROM bounds)"""

SQL = {
    "event_next_sequence": "SELECT workspace_id, coalesce(max(sequence), 0) AS last_sequence, coalesce(max(sequence), 0) + 1 AS next_sequence FROM workspace_events GROUP BY 1",
    "event_gaps": "SELECT * FROM (SELECT workspace_id, lag(sequence) OVER (PARTITION BY workspace_id ORDER BY sequence) AS previous, sequence AS current FROM (SELECT DISTINCT workspace_id, sequence FROM workspace_events WHERE sequence IS NOT NULL)) WHERE current <> previous + 1",
    "event_recent": f"WITH {_LOG} SELECT workspace_id, sequence, id, kind, row_number() OVER (PARTITION BY workspace_id ORDER BY sequence DESC, id) AS place FROM log QUALIFY place <= 10",
    "event_page": f"WITH {_LOG} SELECT workspace_id, sequence, id, kind FROM log WHERE workspace_id = (SELECT min(workspace_id) FROM workspace_events) AND sequence > 5 ORDER BY sequence, id LIMIT 25",
    "event_external_changes": "SELECT workspace_id, kind, count(DISTINCT sequence) AS events FROM workspace_events WHERE correlation_id IS NULL GROUP BY 1, 2",
    "event_kinds": f"WITH {_LOG} SELECT kind, count(*) AS events, count(DISTINCT workspace_id) AS workspaces, count(*) FILTER (resource_id IS NULL) AS without_resource FROM log GROUP BY 1",
    "projection_freshness": f"WITH {_OUT}, r AS (SELECT projection, workspace_id, max(id) AS latest, count(*) FILTER (id > coalesce(applied, 0)) AS lag FROM outbox LEFT JOIN offsets USING (projection, workspace_id) GROUP BY 1, 2) SELECT projection, workspace_id, coalesce(applied, 0) AS applied, coalesce(latest, 0) AS latest, coalesce(lag, 0) AS lag, coalesce(lag, 0) > 0 AS lagging FROM r FULL OUTER JOIN offsets USING (projection, workspace_id)",
    "projection_batch": f"WITH {_OUT} SELECT projection, workspace_id, id, row_number() OVER (PARTITION BY projection, workspace_id ORDER BY id) AS place FROM outbox LEFT JOIN offsets USING (projection, workspace_id) WHERE id > coalesce(applied, 0) QUALIFY place <= 5",
    "projection_workspaces": f"WITH {_OUT} SELECT workspace_id FROM outbox UNION SELECT workspace_id FROM offsets",
    "metric_summary": "SELECT event_type AS name, count(value) AS count, round(coalesce(sum(value), 0), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS highest, round(arg_max(value, (ts, event_id)), 4) AS last, round(coalesce(avg(value), 0), 4) AS average FROM events GROUP BY 1",
    "metric_rate": "SELECT user_id, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'error') AS misses, round(coalesce(count(*) FILTER (event_type = 'click')::double / nullif(count(*) FILTER (event_type IN ('click', 'error')), 0), 0), 6) AS rate FROM events GROUP BY 1",
    "metric_outcomes": "SELECT event_type || '_' || CASE WHEN value >= 50 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS events FROM events GROUP BY 1",
    "resource_latest": f"WITH {_LATEST} SELECT id, last_sequence, state_version, status, current_path, workspace_id FROM latest",
    "resource_counts": f"WITH {_LATEST} SELECT workspace_id, count(*) AS resources, count(*) FILTER (status = 'current') AS current, max(last_sequence) AS last_sequence FROM latest GROUP BY 1",
    "resource_affected": "SELECT DISTINCT id FROM resources WHERE id IN (SELECT resource_id FROM workspace_events WHERE kind = 'external_change')",
    "resource_reconcile": f"""WITH {_LATEST}, d AS (SELECT current_path AS path, max(resource_id) AS h FROM ({changefeed.SQL["p5_found"]}) WHERE current_path IS NOT NULL GROUP BY 1),
t AS (SELECT current_path AS path, max(id) AS h FROM latest WHERE status = 'current' AND current_path IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT path, CASE WHEN t.h IS NULL THEN 'created' WHEN d.h IS NULL THEN 'deleted' WHEN t.h <> d.h THEN 'updated' END AS change FROM d FULL OUTER JOIN t USING (path)) WHERE change IS NOT NULL""",
    "lease_conflicts": """WITH l AS (SELECT o_orderkey AS k, o_orderdate AS d, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT a.k AS request_id, b.k AS lease_id, array_to_string(list_sort(list(DISTINCT a.p)), ',') AS paths FROM l a JOIN l b ON a.p = b.p AND a.k <> b.k
WHERE a.d > date '1998-07-20' AND a.d <= date '1998-08-20' AND b.d <= date '1998-07-20' AND CAST(b.d AS DATE) + 14 > date '1998-07-20' GROUP BY 1, 2""",
    "brief_fit": f"WITH RECURSIVE {_BRIEF} SELECT workspace_id, key, section, cost, included FROM walk",
    "brief_omitted": f"WITH RECURSIVE {_BRIEF} SELECT workspace_id, section, count(*) AS omitted FROM walk WHERE NOT included GROUP BY 1, 2",
    "packed_chunks": r"""WITH RECURSIVE c AS (SELECT file_id, ordinal, max(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(regexp_replace(text, '[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) // 3) END) AS cost FROM chunks WHERE file_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal) AS i FROM c),
w AS (SELECT file_id, ordinal, i, 0 AS pack, cost AS used FROM n WHERE i = 1
  UNION ALL SELECT n.file_id, n.ordinal, n.i, CASE WHEN w.used + n.cost > 512 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.used + n.cost > 512 THEN n.cost ELSE w.used + n.cost END FROM w JOIN n ON n.file_id = w.file_id AND n.i = w.i + 1)
SELECT file_id, ordinal, pack FROM w""",
    "interval_speakers": f"""WITH {_MARKS}, sp AS (SELECT user_id, ms - 7200000 AS start_ms, ms + 7200000 AS end_ms, event_id AS label FROM marks WHERE event_type = 'view'),
pairs AS (SELECT s.user_id, s.start_ms, s.ord, p.label, p.start_ms < s.start_ms AS early, least(s.end_ms, p.end_ms) - greatest(s.start_ms, p.start_ms) AS o FROM segments s JOIN sp p ON p.user_id = s.user_id AND p.start_ms < s.end_ms AND s.start_ms < p.end_ms),
top AS (SELECT *, max(o) OVER (PARTITION BY user_id, start_ms) AS m FROM pairs),
best AS (SELECT user_id, start_ms, coalesce(max(label) FILTER (early), min(label)) AS label FROM top WHERE o = m GROUP BY 1, 2)
SELECT s.user_id, s.start_ms, s.end_ms, label FROM segments s LEFT JOIN best b ON b.user_id = s.user_id AND b.start_ms = s.start_ms""",
    "interval_scene_texts": f"""WITH {_MARKS}, sc AS (SELECT DISTINCT user_id, ms AS start_ms, ms + 43200000 AS end_ms FROM marks WHERE event_type = 'click')
SELECT c.user_id, c.start_ms, count(s.ord) AS segments, coalesce(string_agg(s.text, chr(10) ORDER BY s.ord), '') AS text FROM sc c LEFT JOIN segments s ON s.user_id = c.user_id AND s.start_ms < c.end_ms AND c.start_ms < s.end_ms GROUP BY 1, 2""",
    "interval_boundaries": f"WITH {_BOUNDS} SELECT user_id, boundary FROM bounds",
    "interval_scenes": f"WITH {_BOUNDS} SELECT user_id, start_ms, end_ms, (start_ms + end_ms) // 2 AS keyframe_ms FROM scenes WHERE end_ms IS NOT NULL",
    "interval_spread": f"""WITH {_BOUNDS}, s AS (SELECT user_id, start_ms, end_ms, (start_ms + end_ms) // 2 AS keyframe_ms, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM scenes WHERE end_ms IS NOT NULL)
SELECT user_id, start_ms, end_ms, keyframe_ms FROM s WHERE n <= 7 OR i IN (SELECT least(n - 1, round_even(k * (n / 7.0::double), 0)) FROM range(7) t(k))""",
}
