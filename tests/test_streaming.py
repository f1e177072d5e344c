import datetime as dt
import sqlite3

import pytest

from pyspark.sql import functions as F

from lodemill.operators.events import gaps, observer_actions
from lodemill.sources.state import export_state, import_state, migrate
from lodemill.streaming.observer import actions, changed_files, invalidating, settled
from lodemill.streaming.projections import deliver, distinct_events, expired, into_parquet, sequence_gaps

KINDS = "workspace_id string, sequence long, received_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def source(spark, path):
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(path)


def put(spark, path, rows):
    spark.createDataFrame([(w, n, T0 + dt.timedelta(seconds=n)) for w, n in rows], KINDS).coalesce(1).write.mode("append").parquet(path)


def test_gaps_across_batches_equal_the_batch_query(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("a", 1), ("a", 2), ("b", 5)], [("a", 4), ("a", 5), ("b", 6)], [("a", 9), ("a", 9), ("b", 7)]]
    seen = []
    put(spark, path, batches[0])
    for k in range(3):
        if k:
            put(spark, path, batches[k])
        q = sequence_gaps(source(spark, path)).writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(seen) == sorted(map(tuple, gaps(spark.read.parquet(path)).collect())) == [("a", 2, 4), ("a", 5, 9)]


def test_delivery_is_repeated_until_it_succeeds(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, path, [("a", 1), ("a", 2)])
    failed = []

    def once(df, n):
        into_parquet(out)(df, n)
        if not failed:
            failed.append(n)
            raise RuntimeError("down")

    try:
        deliver(source(spark, path), once, check).awaitTermination()
    except Exception:  # noqa: BLE001
        pass
    deliver(source(spark, path), once, check).awaitTermination()
    put(spark, path, [("a", 3)])
    deliver(source(spark, path), once, check).awaitTermination()
    assert failed and sorted(r.sequence for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_repeats_are_dropped(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, [("a", 1), ("a", 1), ("a", 2)])
    deliver(distinct_events(source(spark, path)), into_parquet(out), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.sequence for r in spark.read.parquet(out).collect()) == [1, 2]


def test_expiry(spark):
    rows = spark.createDataFrame([("a", "active", T0), ("b", "active", T0 + dt.timedelta(1)), ("c", "released", T0)], "id string, status string, expires_at timestamp")
    assert [r.status for r in expired(rows, F.lit(T0)).orderBy("id").collect()] == ["expired", "active", "released"]


def test_files_are_told_as_they_come(spark, tmp_path):
    root, out = tmp_path / "root", str(tmp_path / "out")
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.md").write_text("one")
    for text in ("two", None):
        deliver(changed_files(spark, str(root)), into_parquet(out), str(tmp_path / "c")).awaitTermination()
        if text:
            (root / "b.md").write_text(text)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.path.rpartition("/")[2], r.size_bytes) for r in rows) == [("a.md", 3), ("b.md", 3)] and all(len(r.content_hash) == 64 for r in rows)


def test_paths_settle_after_a_quiet_time(spark, tmp_path):
    kinds, path, seen = "path string, seen_at timestamp", str(tmp_path / "in"), []
    for rows in ([("a", 0), ("a", 1), ("b", 1)], [("b", 2), ("c", 9)], [("c", 30), (None, 31)], [("d", 99)]):
        spark.createDataFrame([(p, T0 + dt.timedelta(seconds=s)) for p, s in rows], kinds).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kinds).parquet(path)
        settled(stream).writeStream.foreachBatch(lambda df, n: seen.extend((r.path, r.events) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [("a", 2), ("b", 2), ("c", 1), ("c", 1)]


def test_actions_equal_those_of_the_batch_query(spark, tmp_path):
    kinds, path, seen = "workspace_id string, sequence bigint, kind string, resource_id string", str(tmp_path / "in"), []
    rows = [("a", 1, "workspace_registered", None), ("a", 2, "resource_created", "r"), ("a", 4, "resource_updated", "r"), ("a", 5, "external_change", "r"), ("b", 7, "resource_ambiguous", "s")]
    for part in (rows[:2] + rows[:1], rows[2:4] + rows[1:2], rows[4:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(path)
        actions(spark.readStream.schema(kinds).parquet(path)).writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == sorted(map(tuple, observer_actions(spark.createDataFrame(rows, kinds)).collect()))


def test_claims_are_invalidated_batch_by_batch(spark, tmp_path):
    kinds, path, seen = "resource_id string", str(tmp_path / "in"), []
    claims = spark.createDataFrame([("c", "verified"), ("d", "proposed")], "claim_id string, status string")
    evidence = spark.createDataFrame([("c", '{"resource_id":"r"}'), ("c", '{"resource_id":"s"}'), ("d", '{"resource_id":"r"}'), ("c", "broken"), ("c", None)], "claim_id string, reference string")
    handler = invalidating(claims, evidence, lambda df, n: seen.append(sorted(map(tuple, df.collect()))))
    for part in ([("r",), ("r",), (None,)], [("x",)]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(path)
        deliver(spark.readStream.schema(kinds).parquet(path), handler, str(tmp_path / "c")).awaitTermination()
    assert seen == [[("c", "r")], []]


def test_portable_state(tmp_path):
    export_state({"b": 1, "a": [2]}, str(tmp_path), "x/state.json")
    assert import_state(str(tmp_path), "x/state.json") == {"a": [2], "b": 1} and len(list((tmp_path / "x").iterdir())) == 1
    for name in ("../out.json", "/etc/passwd"):
        with pytest.raises(ValueError):
            export_state({}, str(tmp_path), name)
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError):
        import_state(str(tmp_path), "list.json")


def test_migrations(tmp_path):
    path = str(tmp_path / "x.db")
    steps = [(2, "ALTER TABLE t ADD b INT"), (1, "CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")]
    assert migrate(path, steps, upto=1) == [1] and migrate(path, steps) == [2] and migrate(path, steps) == []
    with pytest.raises(sqlite3.OperationalError):
        migrate(path, [*steps, (3, "INSERT INTO t VALUES (5, 6); BROKEN")])
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM t").fetchone() == (1,) and db.execute("PRAGMA user_version").fetchone() == (2,)
    with pytest.raises(ValueError):
        migrate(path, [(1, ""), (1, "")])
