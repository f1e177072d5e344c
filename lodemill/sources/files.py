"""Folders of files as tables, and records in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.text import base_name, extension, matches_any

# The files that are taken and left where nothing else is asked for.
INCLUDE = ["**/*.md", "**/*.txt", "**/*.py", "**/*.ts", "**/*.pdf", "**/*.docx"]
EXCLUDE = ["**/.git/**", "**/node_modules/**", "**/.venv/**", "**/__pycache__/**"]


def scan(spark: SparkSession, root: str, include: list[str] = INCLUDE, exclude: list[str] = EXCLUDE, content: bool = True) -> DataFrame:
    """``path, name, suffix, size_bytes, mtime`` and, if asked for, ``content`` and ``content_hash`` of files below a folder.

    Without the content only the listing is read. A missing folder has no files; empty files are not listed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        kinds = "path string, name string, suffix string, size_bytes bigint, mtime double" + (", content binary, content_hash string" if content else "")
        return spark.createDataFrame([], kinds)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace("path", r"^file:/+", "/")
    columns = [clean.alias("path"), base_name(clean).alias("name"), extension(clean).alias("suffix"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")]
    if content:
        columns += ["content", F.sha2("content", 256).alias("content_hash")]
    wanted = matches_any(clean, include)
    if exclude:
        wanted = wanted & ~matches_any(clean, exclude)
    return raw.where(wanted).select(*columns)


def legacy_records(spark: SparkSession, path: str, imported: DataFrame | None = None) -> DataFrame:
    """Records of an older JSON store: one object by id. Malformed ones are left out, and so are ids imported before."""
    kinds = "map<string, struct<id:string,path:string,name:string,ext:string,mime:string,size_bytes:bigint,mtime:double,content_hash:string,status:string,summary:string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", kinds)).alias("key", "r")).select("r.*").where(F.col("id").isNotNull() & F.col("path").isNotNull())
    return rows if imported is None else rows.join(imported.select("id"), "id", "left_anti")


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of one query on a small SQLite file that every executor can read; read in one task."""

    def read(batches):
        import sqlite3

        import pandas as pd

        for batch in batches:
            for _ in range(len(batch)):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(query, db, chunksize=10_000)

    return spark.range(1).coalesce(1).mapInPandas(read, schema)
