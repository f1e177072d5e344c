"""Records of files: latest rows, counts, work lists, replacement and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLISHABLE = ("indexed", "stale")


def latest_files(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per id: the one indexed last, then changed last; the rest of the order makes it the same on every run.

    An aggregate over structs, so that repeated rows fold before the shuffle. ``keep``: further columns that are
    wanted, all if not told; no others are read. Rows without id are left out.
    """
    lead = ["last_indexed_at", "mtime", "size_bytes", "content_hash", "path", "status"]
    rest = [c for c in files.columns if c not in lead and c != "id" and (keep is None or c in keep)]
    best = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*lead, *rest)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in [*lead, *rest]])


def count_by_status(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("files"))


def work_list(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files that must be indexed: not those known under the same hash as indexed."""
    done = known.where(F.col("status") == "indexed").select("id", "content_hash")
    return scan.join(done, ["id", "content_hash"], "left_anti")


def publishable(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files that are indexed or stale."""
    return chunks.join(files.where(F.col("status").isin(*PUBLISHABLE)).select(F.col("id").alias("f")), F.col("file_id") == F.col("f"), "left_semi")


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys in ``new`` replaced by those of ``new``."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")


def reconcile(disk: DataFrame, tracked: DataFrame) -> DataFrame:
    """``path, change``: created, updated or deleted, of ``path, content_hash`` on disk and tracked; unchanged paths are left out."""
    d = disk.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("on_disk"))
    t = tracked.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("known"))
    both = d.join(t, "path", "full_outer")
    change = F.when(F.col("known").isNull(), "created").when(F.col("on_disk").isNull(), "deleted").when(~F.col("new").eqNullSafe(F.col("old")), "updated")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


def blob_rows(representations: DataFrame) -> DataFrame:
    """``hash, byte_count, references``: each stored blob once, with the number of representations that use it."""
    rows = representations.where(F.col("blob_hash").isNotNull())
    return rows.groupBy(F.col("blob_hash").alias("hash")).agg(F.max("blob_byte_count").alias("byte_count"), F.countDistinct("id").alias("references"))


def blob_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def unreferenced_blobs(representations: DataFrame) -> DataFrame:
    """Blobs that no current representation uses."""
    used = representations.where("is_current").select(F.col("blob_hash").alias("hash"))
    return blob_rows(representations).join(used, "hash", "left_anti")


def stable(looks: DataFrame) -> DataFrame:
    """``id, stable, content_hash`` of files looked at more than once: ``looks(id, seen_at, size_bytes, mtime, content_hash)``.

    A file is stable if size and change time were the same at every look; only then its hash, that of the last look, counts.
    Equal rows are one look.
    """
    once = looks.distinct()
    same = lambda c: F.count_distinct(F.coalesce(F.col(c), F.lit(-1))) == 1
    g = once.groupBy("id").agg(F.count("*").alias("looks"), (same("size_bytes") & same("mtime")).alias("stable"), F.max(F.struct("seen_at", "content_hash")).alias("last"))
    return g.where(F.col("looks") > 1).select("id", "stable", F.when(F.col("stable"), F.col("last.content_hash")).alias("content_hash"))


def nested_roots(roots: DataFrame) -> DataFrame:
    """``outer, inner`` of ``roots(id, root)``: workspaces one of whose roots is that of the other or lies below it.

    Every root is joined by its ancestors, so no pair of unrelated roots is looked at. Of equal roots the least id is the outer.
    """
    parts = F.filter(F.split(F.rtrim("root", F.lit("/")), "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    rows = roots.where(F.col("id").isNotNull() & F.col("root").isNotNull()).select("id", parts.alias("parts")).where(F.size("parts") > 0).distinct()
    inner = rows.select(F.col("id").alias("inner"), F.array_join("parts", "/").alias("own"), F.explode(above).alias("at"))
    outer = rows.select(F.col("id").alias("outer"), F.array_join("parts", "/").alias("at"))
    both = inner.join(outer, "at").where((F.col("inner") != F.col("outer")) & ((F.col("own") != F.col("at")) | (F.col("outer") < F.col("inner"))))
    return both.select("outer", "inner").distinct()


def cleanup_blockers(legacy: DataFrame, imported: DataFrame) -> DataFrame:
    """Ids of an older store that are not imported under the same hash: while there are any, it must not be removed."""
    return legacy.select("id", "content_hash").distinct().join(imported.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
