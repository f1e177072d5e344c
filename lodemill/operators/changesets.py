"""Change sets: what they hold, what makes them stale, how they are verified, validated and undone.

Tables come in as DataFrames with the columns each function names; further columns are ignored, rows whose keys are null
take no part, empty tables give empty results. Nothing here decides whether a change set may run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions.text import glob_regex

# Kinds of operations that leave nothing behind when they are undone.
CREATING = ("create_file", "create_directory")


def metadata(change_sets: DataFrame, operations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``change_set_id, operations, bytes, dependencies`` of ``change_sets(change_set_id)``; 0 where there are none."""
    ops = operations.groupBy("change_set_id").agg(F.count("*").alias("operations"), F.sum("byte_count").alias("bytes"))
    deps = dependencies.groupBy("change_set_id").agg(F.countDistinct("resource_id").alias("dependencies"))
    both = change_sets.select("change_set_id").distinct().join(ops, "change_set_id", "left").join(deps, "change_set_id", "left")
    return both.select("change_set_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("operations", "bytes", "dependencies")])


def compensation(operations: DataFrame, preimages: DataFrame) -> DataFrame:
    """``change_set_id, step, ordinal, kind, preimage``: what undoes a change set, last operation first.

    An operation without a preimage is only undone if it creates something. Of several preimages the least id holds.
    """
    before = preimages.groupBy("change_set_id", "ordinal").agg(F.min("preimage").alias("preimage"))
    both = operations.select("change_set_id", "ordinal", "kind").join(before, ["change_set_id", "ordinal"], "left")
    kept = both.where(F.col("preimage").isNotNull() | F.col("kind").isin(*CREATING))
    return kept.select("change_set_id", F.row_number().over(Window.partitionBy("change_set_id").orderBy(F.desc("ordinal"))).alias("step"), "ordinal", "kind", "preimage")


@dataclass(frozen=True)
class Verifier:
    """When a verifier applies; an empty condition always holds. Patterns are globs over paths."""

    name: str
    risks: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    least_bytes: int | None = None
    most_bytes: int | None = None
    required: bool = field(default=True)


def applicable_verifiers(change_sets: DataFrame, operations: DataFrame, verifiers: list[Verifier]) -> DataFrame:
    """``change_set_id, verifier`` of ``change_sets(change_set_id, risk)``: every condition is met by some operation.

    The verifiers are a short list, so their conditions are columns of one aggregate over the operations.
    """
    checks = {}
    for n, v in enumerate(verifiers):
        if v.kinds:
            checks[f"k{n}"] = F.bool_or(F.col("kind").isin(*v.kinds))
        if v.patterns:
            checks[f"p{n}"] = F.bool_or(_any(F.col("path").rlike(glob_regex(p)) for p in v.patterns))
        if v.least_bytes is not None:
            checks[f"l{n}"] = F.bool_or(F.col("byte_count") >= v.least_bytes)
        if v.most_bytes is not None:
            checks[f"m{n}"] = F.bool_or(F.col("byte_count") <= v.most_bytes)
    met = operations.groupBy("change_set_id").agg(F.lit(1).alias("some"), *[c.alias(name) for name, c in checks.items()])
    rows = change_sets.select("change_set_id", "risk").join(met, "change_set_id", "left")
    found = []
    for n, v in enumerate(verifiers):
        holds = F.col("risk").isin(*v.risks) if v.risks else F.lit(True)
        for name in (f"{c}{n}" for c in "kplm"):
            if name in checks:
                holds = holds & F.coalesce(F.col(name), F.lit(False))
        found.append(F.when(holds, F.lit(v.name)))
    return rows.select("change_set_id", F.explode(F.array_compact(F.array(*found))).alias("verifier"))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def verification(change_sets: DataFrame, executions: DataFrame) -> DataFrame:
    """Per change set the required, passed, failed and timed-out executions and what follows from them.

    ``change_sets(change_set_id, owner_verified)``, ``executions(change_set_id, required, exit_code, timed_out)``. As many
    executions as are required must pass, whichever they are.
    """
    passed = ~F.col("timed_out") & (F.col("exit_code") == 0)
    counts = executions.groupBy("change_set_id").agg(
        F.count("*").alias("applicable"), F.count_if("required").alias("required"), F.count_if(passed).alias("passed"),
        F.count_if(~F.col("timed_out") & (F.col("exit_code") != 0)).alias("failed"), F.count_if("timed_out").alias("timeouts"),
    )
    names = ["applicable", "required", "passed", "failed", "timeouts"]
    both = change_sets.select("change_set_id", "owner_verified").join(counts, "change_set_id", "left").select("change_set_id", "owner_verified", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    whole = (F.col("required") == 0) | (F.col("passed") == F.col("required"))
    proceed = whole & (F.col("owner_verified") | (F.col("required") == 0))
    return both.select("change_set_id", *names[1:], whole.alias("all_required"), ((F.col("required") > 0) & (F.col("passed") > 0)).alias("any_required"), proceed.alias("verified"), (~proceed & (F.col("applicable") == 0)).alias("unverified"))


def precommit(dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """``change_set_id, verdict``: ``ok`` or the first fault of its dependencies: ``present``, ``version`` or ``hash``.

    ``dependencies(change_set_id, resource_id, expected_absent, expected_version, expected_hash)`` against ``current(
    resource_id, version, hash)`` with one row a resource. A null expectation asks nothing; a missing resource equals none.
    """
    now = current.select("resource_id", "version", "hash", F.lit(True).alias("there"))
    both = dependencies.join(now, "resource_id", "left")
    version = F.col("expected_version").isNotNull() & ~F.col("expected_version").eqNullSafe(F.col("version"))
    digest = F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(F.col("hash"))
    fault = F.when(F.col("expected_absent"), F.when(F.col("there"), "a:present")).when(version, "b:version").when(digest, "c:hash")
    return both.groupBy("change_set_id").agg(F.coalesce(F.substring(F.min(fault), 3, 20), F.lit("ok")).alias("verdict"))


def staleness(change_sets: DataFrame, dependencies: DataFrame, events: DataFrame) -> DataFrame:
    """``change_set_id, latest, stale``: the last event since its validation that touches a dependency, or is external.

    ``change_sets(change_set_id, workspace_id, since)``, ``dependencies(change_set_id, resource_id)``. Events are folded to
    the last of each resource and the last external one of each workspace before any join, so no change set meets events
    one by one.
    """
    of = events.where(F.col("resource_id").isNotNull()).groupBy("workspace_id", "resource_id").agg(F.max("sequence").alias("last"))
    outside = events.where(F.col("kind") == "external_change").groupBy("workspace_id").agg(F.max("sequence").alias("outside"))
    asked = dependencies.join(change_sets.select("change_set_id", "workspace_id"), "change_set_id").join(of, ["workspace_id", "resource_id"])
    touched = asked.groupBy("change_set_id").agg(F.max("last").alias("touched"))
    both = change_sets.select("change_set_id", "workspace_id", "since").join(touched, "change_set_id", "left").join(outside, "workspace_id", "left")
    latest = F.greatest("touched", "outside")
    return both.select("change_set_id", F.when(latest > F.col("since"), latest).alias("latest"), F.coalesce(latest > F.col("since"), F.lit(False)).alias("stale"))


_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def last_validated(transitions: DataFrame, events: DataFrame) -> DataFrame:
    """``change_set_id, sequence`` of the event that the last transition's evidence names, whatever the evidence's form.

    Ids are taken out of the evidence and joined by equality, instead of looking for every event in every text. Of several
    events in the last transition the highest sequence holds.
    """
    named = transitions.select("change_set_id", "occurred_at", F.explode(F.array_distinct(F.regexp_extract_all("evidence", F.lit(f"({_UUID})"), 1))).alias("event_id"))
    known = events.groupBy(F.col("id").alias("event_id")).agg(F.max("sequence").alias("sequence"))
    return named.join(known, "event_id").groupBy("change_set_id").agg(F.max(F.struct("occurred_at", "sequence")).alias("m")).select("change_set_id", "m.sequence")


def triggers_in_order(triggers: DataFrame, events: DataFrame, most: int = 50) -> DataFrame:
    """``change_set_id, place, event_id, kind``: the events of ``triggers(change_set_id, event_id)``, the latest first, ``most`` a change set."""
    both = triggers.select("change_set_id", "event_id").distinct().join(events.select(F.col("id").alias("event_id"), "kind", "occurred_at"), "event_id")
    order = Window.partitionBy("change_set_id").orderBy(F.desc_nulls_last("occurred_at"), "event_id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("change_set_id", "place", "event_id", "kind")


def freshness(validations: DataFrame, now: Column, most_seconds: int = 300) -> DataFrame:
    """``change_set_id, validated_at, fresh`` of the latest validation; ``now`` is given, so a run can be repeated."""
    latest = validations.where(F.col("validated_at").isNotNull()).groupBy("change_set_id").agg(F.max("validated_at").alias("validated_at"))
    age = (F.unix_micros(now) - F.unix_micros("validated_at")) / 1e6
    return latest.select("change_set_id", "validated_at", (age <= most_seconds).alias("fresh"))


def same_violations(before: Column, after: Column) -> Column:
    """Whether two lists name the same things, whatever their order and repeats; null is an empty list."""
    ordered = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array())))
    return ordered(before) == ordered(after)


def successor_verdicts(proposed: DataFrame, linked: DataFrame, known: DataFrame) -> DataFrame:
    """``predecessor, successor, verdict`` of proposals: ``accepted`` or why not.

    Both must be in ``known(id)``; a predecessor has one successor (``has_successor``) and is none itself
    (``is_successor``). Of several proposals for a predecessor the least successor is taken, the others ``repeated``.
    """
    asked = proposed.select("predecessor", "successor").distinct()
    ids = known.select("id").distinct()
    for end in ("predecessor", "successor"):
        asked = asked.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_known")), end, "left")
    asked = asked.join(linked.select("predecessor", F.lit(True).alias("has")).distinct(), "predecessor", "left")
    asked = asked.join(linked.select(F.col("successor").alias("predecessor"), F.lit(True).alias("is")).distinct(), "predecessor", "left")
    asked = asked.join(asked.where(F.col("successor_known")).groupBy("predecessor").agg(F.min("successor").alias("taken")), "predecessor", "left")
    verdict = F.when(F.col("predecessor_known").isNull() | F.col("successor_known").isNull(), "unknown").when(F.col("has"), "has_successor").when(F.col("is"), "is_successor")
    return asked.select("predecessor", "successor", verdict.when(F.col("successor") != F.col("taken"), "repeated").otherwise("accepted").alias("verdict"))


def recovery(change_sets: DataFrame, preimages: DataFrame) -> DataFrame:
    """What a restart may do with ``change_sets(change_set_id, applying, interrupted)``, given ``preimages(change_set_id, intact)``."""
    lost = preimages.groupBy("change_set_id").agg(F.count_if(~F.col("intact")).alias("lost"))
    both = change_sets.join(lost, "change_set_id", "left").select("change_set_id", "applying", "interrupted", F.coalesce("lost", F.lit(0)).alias("lost"))
    broken = F.col("lost") > 0
    reason = F.when(broken, "preimages are lost").when(F.col("applying") & F.col("interrupted"), "apply and rollback are incomplete")
    return both.select("change_set_id", "lost", (~F.col("applying") & ~F.col("interrupted") & ~broken).alias("can_apply"), (~broken).alias("can_roll_back"), (F.col("interrupted") & ~broken).alias("can_resume"), reason.alias("reason"))


def invalidated_claims(claims: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """``claim_id, resource_id``: verified claims with evidence whose JSON reference names a changed resource.

    ``claims(claim_id, status)``, ``evidence(claim_id, reference)``, ``changed(resource_id)``. A claim that cites several
    changed resources has a row for each.
    """
    cited = evidence.select("claim_id", F.get_json_object("reference", "$.resource_id").alias("resource_id")).where(F.col("resource_id").isNotNull()).distinct()
    cited = cited.join(changed.select("resource_id").distinct(), "resource_id", "left_semi")
    return cited.join(claims.where(F.col("status") == "verified").select("claim_id"), "claim_id", "left_semi").select("claim_id", "resource_id")


def invalidated_media_claims(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """``claim_id``: evidence that names a changed version, and the representation if the change names one.

    ``changed(resource_version_id, representation_id)``; a null representation means all of the version.
    """
    version, part = F.get_json_object("reference", "$.resource_version_id"), F.get_json_object("reference", "$.representation_id")
    cited = evidence.select("claim_id", version.alias("resource_version_id"), part.alias("representation_id")).distinct()
    whole = cited.join(changed.where(F.col("representation_id").isNull()).select("resource_version_id"), "resource_version_id", "left_semi")
    parts = cited.join(changed.where(F.col("representation_id").isNotNull()), ["resource_version_id", "representation_id"], "left_semi")
    return whole.select("claim_id").union(parts.select("claim_id")).distinct()


def originals(versions: DataFrame, resources: DataFrame) -> DataFrame:
    """``version_id, resource_id, path, status``: what each cited version is a version of."""
    return versions.select("version_id", "resource_id").distinct().join(resources.select(F.col("id").alias("resource_id"), F.col("current_path").alias("path"), "status"), "resource_id").select("version_id", "resource_id", "path", "status")


def commands(current: DataFrame, asked: DataFrame) -> DataFrame:
    """``resource_id, expected, verdict, version`` of commands that name the version they were made for.

    A command is ``applied`` to make the next version if the resource still has the expected one, else there is a
    ``conflict``; one without a resource on record is ``missing``. Equal commands are one.
    """
    both = asked.select("resource_id", "expected").distinct().join(current.select("resource_id", "version"), "resource_id", "left")
    fits = F.col("expected") == F.col("version")
    return both.select("resource_id", "expected", F.when(F.col("version").isNull(), "missing").when(fits, "applied").otherwise("conflict").alias("verdict"), F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def appended(log: DataFrame, new: DataFrame, projections: list[str]) -> tuple[DataFrame, DataFrame]:
    """New events with the next sequences of their workspaces, and their outbox rows, one per projection.

    ``new(workspace_id, id, kind, occurred_at)`` is a batch; its rows take effect by time, then id. A row whose id is in
    the log already is not appended again.
    """
    last = log.groupBy("workspace_id").agg(F.max("sequence").alias("last"))
    fresh = new.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")
    order = Window.partitionBy("workspace_id").orderBy(F.asc_nulls_last("occurred_at"), "id")
    rows = fresh.withColumn("place", F.row_number().over(order)).join(last, "workspace_id", "left")
    rows = rows.select("workspace_id", "id", "kind", (F.coalesce("last", F.lit(0)) + F.col("place")).alias("sequence"))
    return rows, rows.select("workspace_id", F.col("id").alias("event_id"), "sequence", F.explode(F.array(*map(F.lit, projections))).alias("projection"))
