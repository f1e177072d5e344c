"""Queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm import abuse, components, leakage, mixing, nearest, scans, splitting
from lodemill.llm.near_duplicates import NearDuplicates
from lodemill.session import table


def near_duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), "id", "text")
    files = table(spark, sf_dir, "files").select(F.lit("file").alias("kind"), "id", F.col("summary").alias("text"))
    return chunks.unionByName(files)


def _near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(near_duplicate_records(spark, sf_dir), shingle=3, least=0.6, least_words=8)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).found_pairs().withColumnRenamed("kind", "record_kind")


_P1_PAIRS = """
r AS (SELECT DISTINCT record_kind, id, w FROM (
    SELECT 'chunk' AS record_kind, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM chunks
    UNION ALL SELECT 'file', id, regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+') FROM files)
  WHERE id IS NOT NULL AND len(w) >= 8),
n AS (SELECT *, row_number() OVER () AS no FROM r),
g AS (SELECT DISTINCT record_kind, id, no, array_to_string(w[p : p + 2], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM n)),
size AS (SELECT no, count(*) AS k FROM g GROUP BY no),
met AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, a.no AS x, b.no AS y, count(*) AS both_have FROM g a JOIN g b ON a.gram = b.gram AND a.record_kind = b.record_kind AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT DISTINCT record_kind, id_a, id_b FROM met JOIN size s ON s.no = x JOIN size t ON t.no = y WHERE both_have >= 0.6::double * (s.k + t.k - both_have))"""
_P1 = f"WITH {_P1_PAIRS} SELECT * FROM pairs"
_P1_GROUPS = f"""
WITH RECURSIVE {_P1_PAIRS},
links AS (SELECT record_kind, id_a AS a, id_b AS b FROM pairs UNION SELECT record_kind, id_b, id_a FROM pairs UNION SELECT record_kind, id, id FROM r),
reach(record_kind, id, other) AS (SELECT record_kind, a, b FROM links UNION SELECT reach.record_kind, reach.id, links.b FROM reach JOIN links ON reach.record_kind = links.record_kind AND reach.other = links.a)
SELECT record_kind, id, min(other) AS group_id FROM reach GROUP BY record_kind, id
"""


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).groups().withColumnRenamed("kind", "record_kind")


def _scans(spark: SparkSession, sf_dir: str) -> scans.ScannedTexts:
    return scans.ScannedTexts(table(spark, sf_dir, "representations").select("id", "kind", F.col("textual_payload").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).defects().withColumnRenamed("id", "representation_id")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).repaired().withColumnRenamed("id", "representation_id")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(table(spark, sf_dir, "chunks"))


_P3 = """
WITH v AS (SELECT DISTINCT id, vector::double[64] AS v FROM chunks
  WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
d AS (SELECT a.id, b.id AS neighbour, min(array_distance(a.v, b.v) ^ 2) AS square FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id, b.id),
k AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(square, 9), neighbour) AS rank, neighbour FROM d)
SELECT id, rank::int AS rank, neighbour FROM k WHERE rank <= 5
"""


def p3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_neighbours(spark, sf_dir).drop("square")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_neighbours(spark, sf_dir).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def duplicate_links(spark: SparkSession, sf_dir: str, least: float = 0.8, most: float = 1.0) -> DataFrame:
    """The rows of duplicates that link two recorded files: a similarity between the bounds, different ids, both in files."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id")).where(F.col("file_id").isNotNull()).distinct()
    links = table(spark, sf_dir, "duplicates").where((F.col("src") != F.col("dst")) & F.col("similarity").between(least, most))
    links = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    for end in ("src", "dst"):
        links = links.join(files, links[end] == files["file_id"], "left_semi")
    return links


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.link_groups(duplicate_links(spark, sf_dir)).select("group_id", F.col("member").alias("file_id"))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("files"))


_P4 = """
WITH RECURSIVE links AS (
  SELECT DISTINCT src AS a, dst AS b FROM (
    SELECT src, dst FROM duplicates WHERE src <> dst AND similarity BETWEEN 0.8 AND 1.0 AND similarity::varchar <> 'nan'
    UNION ALL SELECT dst, src FROM duplicates WHERE src <> dst AND similarity BETWEEN 0.8 AND 1.0 AND similarity::varchar <> 'nan')
  WHERE src IN (SELECT id FROM files) AND dst IN (SELECT id FROM files)),
reach(file_id, other) AS (
  SELECT a, a FROM links UNION SELECT reach.file_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT file_id, min(other) AS group_id FROM reach GROUP BY file_id
"""


def chunk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct chunks with the limits of their file's mime, or of ``default`` where file, mime or row is missing."""
    columns = ["target_tokens", "overlap", "separator_hierarchy"]
    limits = table(spark, sf_dir, "chunking_thresholds").where(F.col("media_type").isNotNull()).groupBy("media_type").agg(F.max(F.struct(*columns)).alias("own"))
    # Two values of a small table: the least limit, below which no text is joined, and the limits that hold by default.
    known = limits.agg(F.min("own.target_tokens").alias("least"), F.max(F.when(F.col("media_type") == "default", F.col("own"))).alias("usual")).first()
    usual = F.struct(F.lit(known.usual[0]).cast("int").alias(columns[0]), F.lit(known.usual[1]).cast("int").alias(columns[1]), F.array(*map(F.lit, known.usual[2] or [""])).alias(columns[2])) if known.usual else F.lit(None).cast("struct<target_tokens:int,overlap:int,separator_hierarchy:array<string>>")
    mimes = table(spark, sf_dir, "files").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file")).agg(F.max("mime").alias("mime"))
    own = mimes.join(limits, F.col("mime") == F.col("media_type")).select("file", "own")
    chunks = table(spark, sf_dir, "chunks").select("id", "file_id", "text").where(splitting.token_count(F.col("text")) > (known.least if known.least is not None else 0))
    joined = chunks.join(own, F.col("file_id") == F.col("file"), "left")
    return joined.select("id", "text", F.coalesce("own", usual).alias("limits")).select("id", "text", "limits.*")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(chunk_limits(spark, sf_dir), "id", "text", "target_tokens", "overlap", "separator_hierarchy")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where(F.col("piece") == 1).select(F.col("item_id").alias("chunk_id")).distinct()


_P6 = """
WITH m AS (SELECT id, max(mime) AS mime FROM files GROUP BY id),
l AS (SELECT c.id, length(regexp_replace(c.text, '[\\x{0009}-\\x{000d}\\x{0020}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) // 3 AS tokens,
    coalesce(t.target_tokens, (SELECT max(target_tokens) FROM chunking_thresholds WHERE media_type = 'default')) AS target
  FROM chunks c LEFT JOIN m ON m.id = c.file_id LEFT JOIN chunking_thresholds t ON t.media_type = m.mime)
SELECT DISTINCT id AS chunk_id FROM l WHERE tokens > target
"""


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if("exact").alias("exact_documents"))


_P7 = """
WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT k, id, array_to_string(ws[p : p + 11], ' ') AS gram FROM (SELECT k, id, ws, unnest(range(1, len(ws) - 10)) AS p FROM w))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (gram) WHERE d.k = 'd' AND i.k = 'i'
"""


def _mix(spark: SparkSession, sf_dir: str):
    docs = mixing.counted(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(*_mix(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where("short").select("source")


def p8_shares_in_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mix whose sizes are characters; what a source gives is told where all it has is taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    reached = mixing.reached_shares(*mixing.mix(docs, table(spark, sf_dir, "mix_targets")))
    return reached.select("source", "target_share", "max_repeats", "capacity", "needed", "short", F.when(F.col("short"), F.col("tokens")).alias("given"), F.when(F.col("short"), F.col("passes")).alias("passes"))


_P8_CHARACTERS = """
WITH d AS (SELECT lower(trim(source)) AS source, coalesce(length(text), 0) AS n FROM documents),
h AS (SELECT source, sum(n)::bigint AS n FROM d GROUP BY source),
t AS (SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT t.source, target_share, max_repeats, (coalesce(n, 0) * max_repeats)::bigint AS capacity, target_share * (SELECT sum(n) FROM d)::double AS needed FROM t LEFT JOIN h USING (source))
SELECT *, capacity < needed AS short, CASE WHEN capacity < needed THEN capacity END AS given,
  CASE WHEN capacity < needed THEN CASE WHEN capacity > 0 THEN max_repeats ELSE 0 END END AS passes FROM p
"""
_P8 = """
WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS n FROM documents),
h AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT t.source FROM mix_targets t LEFT JOIN h ON h.source = lower(trim(t.source))
WHERE coalesce(h.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM d)
"""


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).select("doc_id", F.explode("categories").alias("category"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), p9_scores(spark, sf_dir))


def p9_reviewed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates among the reviewed documents, by their reviewers."""
    return abuse.rates(table(spark, sf_dir, "documents"), abuse.reviewed(table(spark, sf_dir, "review_labels")))


_P9_REVIEWED = """
WITH k AS (SELECT doc_id, reviewer, max((category = 'abusive')::int) AS a, max((category = 'hateful')::int) AS h, max((category = 'sexual')::int) AS s FROM review_labels
  WHERE doc_id IS NOT NULL AND reviewer IS NOT NULL AND category IN ('none', 'abusive', 'hateful', 'sexual') GROUP BY ALL),
m AS (SELECT doc_id, avg(a) > 0.5 AS a, avg(h) > 0.5 AS h, avg(s) > 0.5 AS s FROM k GROUP BY doc_id)
SELECT lower(trim(source)) AS source, count(*) AS documents, avg(a::int) AS abusive_rate, avg(h::int) AS hateful_rate, avg(s::int) AS sexual_rate
FROM m JOIN documents USING (doc_id) GROUP BY 1
"""
QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_ranks": p3_ranks,
    "p4_found": p4_found,
    "p4_group_sizes": p4_group_sizes,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_schedule": p8_schedule,
    "p8_shares": p8_shares,
    "p8_shares_in_characters": p8_shares_in_characters,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    "p9_reviewed_rates": p9_reviewed_rates,
}
SQL = {
    "p1_found": _P1,
    "p1_groups": _P1_GROUPS,
    "p3_ranks": _P3,
    "p3_found": f"SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM ({_P3})",
    "p4_found": _P4,
    "p4_group_sizes": f"SELECT group_id, count(*) AS files FROM ({_P4}) GROUP BY group_id",
    "p6_found": _P6,
    "p7_found": _P7,
    "p8_found": _P8,
    "p9_reviewed_rates": _P9_REVIEWED,
    "p8_shares_in_characters": _P8_CHARACTERS,
}
