"""Change sets, claims and commands, on orders and their lines and on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.operators import changesets, events
from lodemill.operators.changesets import Verifier
from lodemill.session import table

VERIFIERS = [
    Verifier("always"),
    Verifier("urgent", risks=("1-URGENT", "2-HIGH")),
    Verifier("deletes", kinds=("delete_file",)),
    Verifier("tens", patterns=("dir?0/*", "dir*/part_?.f")),
    Verifier("large", least_bytes=90_000),
    Verifier("small urgent", risks=("1-URGENT",), kinds=("create_file", "modify_file"), most_bytes=2_000),
]


def _operations(spark, sf_dir) -> DataFrame:
    """Lines as operations; of several lines with one number the one with the least part holds."""
    kind = F.when(F.col("l_returnflag") == "A", "create_file").when(F.col("l_returnflag") == "N", "modify_file").otherwise("delete_file")
    path = F.concat(F.lit("dir"), "l_suppkey", F.lit("/part_"), "l_partkey", F.lit("."), F.lower("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_set_id"), F.col("l_linenumber").alias("ordinal"), F.struct(F.col("l_partkey").alias("resource_id"), kind.alias("kind"), path.alias("path"), F.floor("l_extendedprice").alias("byte_count"), "l_tax", "l_discount", "l_quantity").alias("x"))
    return rows.groupBy("change_set_id", "ordinal").agg(F.min("x").alias("x")).select("change_set_id", "ordinal", "x.*")


_OPERATIONS = """operations AS (
  SELECT * EXCLUDE (n) FROM (SELECT l_orderkey AS change_set_id, l_linenumber AS ordinal, l_partkey AS resource_id,
    CASE l_returnflag WHEN 'A' THEN 'create_file' WHEN 'N' THEN 'modify_file' ELSE 'delete_file' END AS kind,
    'dir' || l_suppkey || '/part_' || l_partkey || '.' || lower(l_linestatus) AS path, floor(l_extendedprice)::bigint AS byte_count, l_tax, l_discount, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, CASE l_returnflag WHEN 'A' THEN 'create_file' WHEN 'N' THEN 'modify_file' ELSE 'delete_file' END,
      'dir' || l_suppkey || '/part_' || l_partkey || '.' || lower(l_linestatus), floor(l_extendedprice)::bigint, l_tax, l_discount, l_quantity) AS n FROM lineitem) WHERE n = 1)"""


def _orders(spark, sf_dir, *more) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_set_id"), *more)


def change_set_metadata(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return changesets.metadata(_orders(spark, sf_dir), _operations(spark, sf_dir), lines.select(F.col("l_orderkey").alias("change_set_id"), F.col("l_partkey").alias("resource_id")))


def change_set_compensation(spark, sf_dir) -> DataFrame:
    ops = _operations(spark, sf_dir)
    return changesets.compensation(ops, ops.where(F.col("l_tax") > 0.03).select("change_set_id", "ordinal", F.col("path").alias("preimage")))


def change_set_verifiers(spark, sf_dir) -> DataFrame:
    return changesets.applicable_verifiers(_orders(spark, sf_dir, F.col("o_orderpriority").alias("risk")), _operations(spark, sf_dir), VERIFIERS)


def change_set_verification(spark, sf_dir) -> DataFrame:
    runs = _operations(spark, sf_dir).select("change_set_id", (F.col("l_discount") > 0.04).alias("required"), F.when(F.col("kind") == "delete_file", 1).otherwise(0).alias("exit_code"), (F.col("l_tax") >= 0.08).alias("timed_out"))
    return changesets.verification(_orders(spark, sf_dir, (F.col("o_orderstatus") == "F").alias("owner_verified")), runs)


def change_set_precommit(spark, sf_dir) -> DataFrame:
    ops = _operations(spark, sf_dir)
    asked = ops.select("change_set_id", "resource_id", (F.col("l_quantity") > 45).alias("expected_absent"), F.when(F.col("l_quantity") > 10, F.col("resource_id") % 7).alias("expected_version"), F.when(F.col("kind") != "create_file", F.concat(F.lit("Brand#"), (F.col("resource_id") % 5).cast("string"))).alias("expected_hash"))
    now = table(spark, sf_dir, "part").where(F.col("p_size") > 5).select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_size") > 40, F.col("p_partkey") % 5).otherwise(F.col("p_partkey") % 7).alias("version"), F.col("p_brand").alias("hash"))
    return changesets.precommit(asked, now)


def _resources(spark, sf_dir) -> DataFrame:
    return events.latest_per_key(table(spark, sf_dir, "resources").where(F.col("id").isNotNull()), "id", ["last_sequence", "state_version"], ["workspace_id", "current_path", "status"])


_RESOURCES = """latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_sequence DESC NULLS LAST, state_version DESC NULLS LAST, workspace_id DESC NULLS LAST,
  current_path DESC NULLS LAST, status DESC NULLS LAST) AS n FROM resources WHERE id IS NOT NULL) WHERE n = 1)"""


def stale_resources(spark, sf_dir) -> DataFrame:
    """Each resource on record as a change set that depends on it, validated at its last sequence."""
    sets = _resources(spark, sf_dir).select(F.col("id").alias("change_set_id"), "workspace_id", F.col("last_sequence").alias("since"))
    return changesets.staleness(sets, sets.select("change_set_id", F.col("change_set_id").alias("resource_id")), table(spark, sf_dir, "workspace_events"))


def validated_sequences(spark, sf_dir) -> DataFrame:
    """Updates as transitions whose evidence names their event in a JSON text."""
    log = table(spark, sf_dir, "workspace_events")
    moves = log.where((F.col("kind") == "resource_updated") & F.col("resource_id").isNotNull())
    evidence = F.to_json(F.struct(F.col("id").alias("event"), F.lit("validated").alias("state")))
    return changesets.last_validated(moves.select(F.col("resource_id").alias("change_set_id"), F.col("received_at").alias("occurred_at"), evidence.alias("evidence")), log)


def stale_triggers(spark, sf_dir) -> DataFrame:
    log = table(spark, sf_dir, "workspace_events").where(F.col("id").isNotNull())
    once = log.groupBy("id").agg(F.min(F.struct("kind", "occurred_at", "resource_id")).alias("e")).select("id", "e.*")
    asked = once.where((F.col("kind") == "external_change") & F.col("resource_id").isNotNull()).select(F.col("resource_id").alias("change_set_id"), F.col("id").alias("event_id"))
    return changesets.triggers_in_order(asked, once)


def validation_freshness(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "resources").where(F.col("id").isNotNull()).select(F.col("id").alias("change_set_id"), F.col("updated_at").alias("validated_at"))
    fresh = changesets.freshness(rows, F.lit("2025-06-01").cast("timestamp"), 90 * 86_400)
    return fresh.select("change_set_id", F.unix_micros("validated_at").alias("validated_us"), "fresh")


def violations_changed(spark, sf_dir) -> DataFrame:
    """Per order whether its returned parts and its parts with a final status are the same."""
    lines = table(spark, sf_dir, "lineitem")
    both = lines.groupBy(F.col("l_orderkey").alias("change_set_id")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("before"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("after"))
    return both.select("change_set_id", (~changesets.same_violations(F.col("before"), F.col("after"))).alias("changed"))


def successor_chains(spark, sf_dir) -> DataFrame:
    links = table(spark, sf_dir, "duplicates").where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    pair = [F.col("src").alias("predecessor"), F.col("dst").alias("successor")]
    sure = F.col("similarity").between(0.9, 1.0)
    return changesets.successor_verdicts(links.where(F.coalesce(~sure, F.lit(True))).select(*pair), links.where(sure).select(*pair), table(spark, sf_dir, "files").where(F.col("id").isNotNull()))


def recovery_analysis(spark, sf_dir) -> DataFrame:
    sets = _orders(spark, sf_dir, (F.col("o_orderstatus") == "P").alias("applying"), (F.col("o_totalprice") > 300_000).alias("interrupted"))
    return changesets.recovery(sets, _operations(spark, sf_dir).select("change_set_id", (F.col("l_quantity") > 3).alias("intact")))


def claims_invalidated(spark, sf_dir) -> DataFrame:
    """Updates as verified claims that cite their resource; the resources on record as deleted have changed."""
    log = table(spark, sf_dir, "workspace_events").where((F.col("kind") == "resource_updated") & F.col("id").isNotNull()).select(F.col("id").alias("claim_id"), F.lit("verified").alias("status"), F.to_json(F.struct("resource_id", "workspace_id")).alias("reference"))
    gone = _resources(spark, sf_dir).where(F.col("status") != "current").select(F.col("id").alias("resource_id"))
    return changesets.invalidated_claims(log, log, gone)


def media_claims_invalidated(spark, sf_dir) -> DataFrame:
    """Each representation as a claim's evidence; failed keyframes change their version, other failures only themselves."""
    rows = table(spark, sf_dir, "representations").where(F.col("id").isNotNull())
    evidence = rows.select(F.col("id").alias("claim_id"), F.to_json(F.struct("resource_version_id", F.col("id").alias("representation_id"))).alias("reference"))
    failed = rows.where(F.col("status") == "failed").select("resource_version_id", F.when(F.col("kind") != "keyframe", F.col("id")).alias("representation_id"))
    return changesets.invalidated_media_claims(evidence, failed)


def cited_originals(spark, sf_dir) -> DataFrame:
    log = table(spark, sf_dir, "workspace_events").where(F.col("kind").isin("resource_created", "resource_updated"))
    return changesets.originals(log.select(F.col("id").alias("version_id"), "resource_id"), _resources(spark, sf_dir))


def resource_commands(spark, sf_dir) -> DataFrame:
    """Every row ever recorded of a resource as a command made for its version."""
    rows = table(spark, sf_dir, "resources").where(F.col("id").isNotNull())
    now = _resources(spark, sf_dir).select(F.col("id").alias("resource_id"), F.col("state_version").alias("version"))
    return changesets.commands(now, rows.select(F.col("id").alias("resource_id"), F.col("state_version").alias("expected")))


def events_appended(spark, sf_dir) -> DataFrame:
    """The external changes as a batch to be appended to the log of the others, with the outbox rows of two projections."""
    log = table(spark, sf_dir, "workspace_events").where(F.col("id").isNotNull())
    once = log.groupBy("id").agg(F.min(F.struct("workspace_id", "kind", "occurred_at", "sequence")).alias("e")).select("id", "e.*")
    new = once.where(F.col("kind") == "external_change").drop("sequence")
    return changesets.appended(once.where(F.col("kind") != "external_change"), new, ["graph", "vector"])[1]


QUERIES = {
    f.__name__: f
    for f in (
        change_set_metadata, change_set_compensation, change_set_verifiers, change_set_verification, change_set_precommit, stale_resources, validated_sequences, stale_triggers, validation_freshness,
        violations_changed, successor_chains, recovery_analysis, claims_invalidated, media_claims_invalidated, cited_originals, resource_commands, events_appended,
    )
}
SQL = {
    "change_set_metadata": f"""WITH {_OPERATIONS},
      o AS (SELECT change_set_id, count(*) AS n, sum(byte_count) AS b FROM operations GROUP BY 1), d AS (SELECT l_orderkey AS change_set_id, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS change_set_id, coalesce(n, 0) AS operations, coalesce(b, 0)::bigint AS bytes, coalesce(k, 0) AS dependencies
      FROM orders LEFT JOIN o ON o.change_set_id = o_orderkey LEFT JOIN d ON d.change_set_id = o_orderkey""",
    "change_set_compensation": f"""WITH {_OPERATIONS},
      k AS (SELECT *, CASE WHEN l_tax > 0.03::double THEN path END AS preimage FROM operations WHERE l_tax > 0.03::double OR kind = 'create_file')
      SELECT change_set_id, row_number() OVER (PARTITION BY change_set_id ORDER BY ordinal DESC)::int AS step, ordinal, kind, preimage FROM k""",
    "change_set_verifiers": f"""WITH {_OPERATIONS},
      m AS (SELECT change_set_id, bool_or(kind = 'delete_file') AS deletes, bool_or(regexp_matches(path, '^dir.0/') OR regexp_matches(path, '^dir.*/part_.[.]f$')) AS tens, bool_or(byte_count >= 90000) AS large,
        bool_or(kind IN ('create_file', 'modify_file')) AS writes, bool_or(byte_count <= 2000) AS small FROM operations GROUP BY 1)
      SELECT o_orderkey AS change_set_id, v.verifier FROM orders LEFT JOIN m ON change_set_id = o_orderkey,
        LATERAL (SELECT unnest([CASE WHEN true THEN 'always' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' END, CASE WHEN deletes THEN 'deletes' END, CASE WHEN tens THEN 'tens' END,
          CASE WHEN large THEN 'large' END, CASE WHEN o_orderpriority = '1-URGENT' AND writes AND small THEN 'small urgent' END]) AS verifier) v WHERE v.verifier IS NOT NULL""",
    "change_set_verification": f"""WITH {_OPERATIONS},
      c AS (SELECT change_set_id, count(*) AS a, count_if(l_discount > 0.04::double) AS r, count_if(l_tax < 0.08::double AND kind <> 'delete_file') AS p, count_if(l_tax < 0.08::double AND kind = 'delete_file') AS f, count_if(l_tax >= 0.08::double) AS t FROM operations GROUP BY 1),
      x AS (SELECT o_orderkey AS change_set_id, o_orderstatus = 'F' AS owner, coalesce(a, 0) AS a, coalesce(r, 0) AS required, coalesce(p, 0) AS passed, coalesce(f, 0) AS failed, coalesce(t, 0) AS timeouts FROM orders LEFT JOIN c ON change_set_id = o_orderkey)
      SELECT change_set_id, required, passed, failed, timeouts, required = 0 OR passed = required AS all_required, required > 0 AND passed > 0 AS any_required,
        (required = 0 OR passed = required) AND (owner OR required = 0) AS verified, NOT ((required = 0 OR passed = required) AND (owner OR required = 0)) AND a = 0 AS unverified FROM x""",
    "change_set_precommit": f"""WITH {_OPERATIONS},
      now AS (SELECT p_partkey AS resource_id, CASE WHEN p_size > 40 THEN p_partkey % 5 ELSE p_partkey % 7 END AS version, p_brand AS hash FROM part WHERE p_size > 5),
      x AS (SELECT o.change_set_id, CASE WHEN l_quantity > 45 THEN CASE WHEN n.resource_id IS NOT NULL THEN 1 ELSE 4 END
          WHEN l_quantity > 10 AND o.resource_id % 7 IS DISTINCT FROM version THEN 2 WHEN kind <> 'create_file' AND 'Brand#' || (o.resource_id % 5) IS DISTINCT FROM hash THEN 3 ELSE 4 END AS fault
        FROM operations o LEFT JOIN now n USING (resource_id))
      SELECT change_set_id, ['present', 'version', 'hash', 'ok'][min(fault)] AS verdict FROM x GROUP BY 1""",
    "stale_resources": f"""WITH {_RESOURCES},
      t AS (SELECT l.id, max(e.sequence) AS latest FROM latest l JOIN workspace_events e ON e.workspace_id = l.workspace_id AND e.sequence > l.last_sequence AND (e.resource_id = l.id OR e.kind = 'external_change') GROUP BY 1)
      SELECT l.id AS change_set_id, latest, latest IS NOT NULL AS stale FROM latest l LEFT JOIN t USING (id)""",
    "validated_sequences": """WITH t AS (SELECT resource_id AS change_set_id, received_at, '{"event":"' || id || '","state":"validated"}' AS evidence FROM workspace_events WHERE kind = 'resource_updated' AND resource_id IS NOT NULL),
      j AS (SELECT t.change_set_id, t.received_at, e.sequence FROM t JOIN workspace_events e ON contains(t.evidence, e.id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY change_set_id ORDER BY received_at DESC NULLS LAST, sequence DESC) AS n FROM j)
      SELECT change_set_id, sequence FROM r WHERE n = 1""",
    "stale_triggers": """WITH f AS (SELECT * EXCLUDE (n) FROM (SELECT id, kind, occurred_at, resource_id, row_number() OVER (PARTITION BY id ORDER BY kind NULLS FIRST, occurred_at NULLS FIRST, resource_id NULLS FIRST) AS n FROM workspace_events WHERE id IS NOT NULL) WHERE n = 1),
      r AS (SELECT resource_id AS change_set_id, row_number() OVER (PARTITION BY resource_id ORDER BY occurred_at DESC NULLS LAST, id)::int AS place, id AS event_id, kind FROM f WHERE kind = 'external_change' AND resource_id IS NOT NULL)
      SELECT * FROM r WHERE place <= 50""",
    "validation_freshness": """SELECT id AS change_set_id, epoch_us(max(updated_at)) AS validated_us, epoch_us('2025-06-01 00:00:00+00'::timestamptz) - epoch_us(max(updated_at)) <= 90 * 86400 * 1000000::bigint AS fresh
      FROM resources WHERE id IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1""",
    "violations_changed": """WITH s AS (SELECT l_orderkey AS change_set_id, coalesce(list_sort(list_distinct(list(l_partkey) FILTER (l_returnflag = 'R'))), []) AS a, coalesce(list_sort(list_distinct(list(l_partkey) FILTER (l_linestatus = 'F'))), []) AS b FROM lineitem GROUP BY 1)
      SELECT change_set_id, a <> b AS changed FROM s""",
    "successor_chains": """WITH d AS (SELECT src, dst, coalesce(similarity BETWEEN 0.9 AND 1.0 AND similarity::varchar <> 'nan', false) AS sure FROM duplicates WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
      p AS (SELECT DISTINCT src, dst FROM d WHERE NOT sure), t AS (SELECT src, min(dst) AS taken FROM p WHERE dst IN (SELECT id FROM files WHERE id IS NOT NULL) GROUP BY 1)
      SELECT p.src AS predecessor, p.dst AS successor, CASE WHEN p.src NOT IN (SELECT id FROM files WHERE id IS NOT NULL) OR p.dst NOT IN (SELECT id FROM files WHERE id IS NOT NULL) THEN 'unknown'
        WHEN p.src IN (SELECT src FROM d WHERE sure) THEN 'has_successor' WHEN p.src IN (SELECT dst FROM d WHERE sure) THEN 'is_successor' WHEN p.dst <> taken THEN 'repeated' ELSE 'accepted' END AS verdict
      FROM p LEFT JOIN t USING (src)""",
    "recovery_analysis": f"""WITH {_OPERATIONS},
      l AS (SELECT change_set_id, count_if(l_quantity <= 3) AS lost FROM operations GROUP BY 1),
      x AS (SELECT o_orderkey AS change_set_id, o_orderstatus = 'P' AS a, o_totalprice > 300000 AS i, coalesce(lost, 0) AS lost FROM orders LEFT JOIN l ON change_set_id = o_orderkey)
      SELECT change_set_id, lost, NOT a AND NOT i AND lost = 0 AS can_apply, lost = 0 AS can_roll_back, i AND lost = 0 AS can_resume,
        CASE WHEN lost > 0 THEN 'preimages are lost' WHEN a AND i THEN 'apply and rollback are incomplete' END AS reason FROM x""",
    "claims_invalidated": f"""WITH {_RESOURCES}
      SELECT DISTINCT e.id AS claim_id, e.resource_id FROM workspace_events e JOIN latest l ON l.id = e.resource_id WHERE e.kind = 'resource_updated' AND e.id IS NOT NULL AND l.status <> 'current'""",
    "media_claims_invalidated": """SELECT DISTINCT r.id AS claim_id FROM representations r JOIN representations f ON f.status = 'failed' AND f.id IS NOT NULL AND f.resource_version_id = r.resource_version_id AND (f.kind = 'keyframe' OR f.id = r.id)
      WHERE r.id IS NOT NULL""",
    "cited_originals": f"""WITH {_RESOURCES}
      SELECT DISTINCT e.id AS version_id, e.resource_id, l.current_path AS path, l.status FROM workspace_events e JOIN latest l ON l.id = e.resource_id WHERE e.kind IN ('resource_created', 'resource_updated')""",
    "resource_commands": f"""WITH {_RESOURCES}
      SELECT DISTINCT r.id AS resource_id, r.state_version AS expected, CASE WHEN l.state_version IS NULL THEN 'missing' WHEN r.state_version = l.state_version THEN 'applied' ELSE 'conflict' END AS verdict,
        CASE WHEN r.state_version = l.state_version THEN l.state_version + 1 ELSE l.state_version END AS version FROM resources r JOIN latest l USING (id)""",
    "events_appended": """WITH f AS (SELECT * EXCLUDE (n) FROM (SELECT id, workspace_id, kind, occurred_at, sequence, row_number() OVER (PARTITION BY id ORDER BY workspace_id NULLS FIRST, kind NULLS FIRST, occurred_at NULLS FIRST, sequence NULLS FIRST) AS n FROM workspace_events WHERE id IS NOT NULL) WHERE n = 1),
      m AS (SELECT workspace_id, max(sequence) AS last FROM f WHERE kind <> 'external_change' GROUP BY 1),
      r AS (SELECT f.workspace_id, id AS event_id, coalesce(last, 0) + row_number() OVER (PARTITION BY f.workspace_id ORDER BY occurred_at NULLS LAST, id) AS sequence FROM f LEFT JOIN m USING (workspace_id) WHERE kind = 'external_change')
      SELECT r.*, unnest(['graph', 'vector']) AS projection FROM r""",
}
