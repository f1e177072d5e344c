"""What users plug in: detectors of types, pipelines that derive representations, encoders that make vectors.

Each is a function of columns or tables, so plugged-in code is part of the plan like any other; a model that needs Python
brings its own Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions.text import glob_regex
from lodemill.operators.vectors import usable


@dataclass(frozen=True)
class Pipeline:
    """Derives a text from rows ``(id, mime, content)``: ``run`` gives ``(id, payload)``. A null payload is a failure."""

    name: str
    pattern: str
    kind: str
    run: Callable[[DataFrame], DataFrame]
    version: str = "1"
    retry: bool = False  # rows that failed are run once more


@dataclass
class Extensions:
    """A registry; of what fits, the first registered wins."""

    detectors: list[Callable[[Column], Column]] = field(default_factory=list)
    pipelines: list[Pipeline] = field(default_factory=list)
    encoders: dict[str, tuple[int, Callable[[Column], Column]]] = field(default_factory=dict)

    def detected(self, content: Column) -> Column:
        """The media type of the first detector that tells one."""
        return F.coalesce(*[d(content) for d in self.detectors]) if self.detectors else F.lit(None).cast("string")

    def produced(self, rows: DataFrame, kind: str, cached: DataFrame | None = None) -> DataFrame:
        """``id, kind, pipeline, status, payload`` of ``rows(id, mime, content)``: what the pipelines of a kind derive.

        A row goes through the first pipeline whose glob fits its type; rows that none fits are ``unavailable``, those
        without a payload ``failed``. Rows in ``cached(id, pipeline, payload)`` under the name and version are not run.
        """
        mine = [p for p in self.pipelines if p.kind == kind]
        pick = F.lit(None).cast("string")
        for p in reversed(mine):
            pick = F.when(F.col("mime").rlike(glob_regex(p.pattern)), F.lit(p.name)).otherwise(pick)
        routed = rows.select("id", "mime", "content", pick.alias("pipeline"))
        none = F.lit(None).cast("string")
        out = routed.where(F.col("pipeline").isNull()).select("id", F.lit(kind).alias("kind"), none.alias("pipeline"), F.lit("unavailable").alias("status"), none.alias("payload"))
        for p in mine:
            label = f"{p.name}@{p.version}"
            todo = routed.where(F.col("pipeline") == p.name).select("id", "mime", "content")
            known = None
            if cached is not None:
                known = cached.where((F.col("pipeline") == label) & F.col("payload").isNotNull()).select("id", "payload")
                known = known.join(todo.select("id"), "id", "left_semi")
                todo = todo.join(known.select("id"), "id", "left_anti")
            done = p.run(todo).select("id", "payload")
            if p.retry:
                again = todo.join(done.where(F.col("payload").isNull()).select("id"), "id", "left_semi")
                done = done.where(F.col("payload").isNotNull()).unionByName(p.run(again).select("id", "payload"))
            done = done if known is None else done.unionByName(known)
            out = out.unionByName(done.select("id", F.lit(kind).alias("kind"), F.lit(label).alias("pipeline"), F.when(F.col("payload").isNull(), "failed").otherwise("current").alias("status"), "payload"))
        return out

    def encoded(self, rows: DataFrame, encoder: str, text: str = "text") -> DataFrame:
        """The rows with ``vector``, null where the encoder gives none of its dimension with finite values only."""
        dimension, encode = self.encoders[encoder]
        return rows.withColumn("vector", encode(F.col(text)).cast("array<double>")).withColumn("vector", F.when(usable(F.col("vector"), dimension), F.col("vector")))
