"""Queries of the text problems and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import neighbours, packing, reading, tokenize
from orrery.plans.staging import stage
from orrery.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.knn(table(spark, d, "vertices_nd"), table(spark, d, "root_metadata")))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    out = neighbours.knn(table(spark, d, "vertices_nd"), table(spark, d, "root_metadata"))
    return out.select("dataset_id", "vid", "rank", "neighbour", F.round(F.sqrt("d2"), 6).alias("distance"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """With leaves so small that the queue chooses among many at any size: whether 0.9 of the true nearest are found."""
    v, root = table(spark, d, "vertices_nd"), table(spark, d, "root_metadata")
    r = neighbours.recall(stage(neighbours.knn(v, root, leaf_rows=16), "small-leaves"), v, root)
    return r.select("dataset_id", "n_queries", "n_true", (F.col("n_hit") >= 0.9 * F.col("n_true")).alias("enough"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "byte_bpe_50k")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by public tokenizer: how many have tokens, and how many have none though their text is not empty."""
    docs, parts = table(spark, d, "documents"), []
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        n = tokenize.token_counts(docs, name).join(docs.select("doc_id", "text"), "doc_id")
        blank = F.coalesce(F.length(F.regexp_replace("text", r"(?U)\s", "")), F.lit(0)) == 0
        parts.append(n.agg(F.lit(name).alias("tokenizer"), F.count("*").alias("n_docs"), F.count_if((F.col("n") == 0) & ~blank).alias("n_lost"), F.count_if((F.col("n") > 0) & (F.coalesce(F.length("text"), F.lit(0)) == 0)).alias("n_made_up")))
    return reduce(DataFrame.unionByName, parts)


def p6_decode(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.decode(stage(p6_ids(spark, d), "ids"), "byte_bpe_50k")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    containers, documents, parts = table(spark, d, "containers"), table(spark, d, "documents"), []
    for (name,) in containers.select("tokenizer").distinct().orderBy("tokenizer").collect():  # a fixed table
        parts.append(packing.pack(tokenize.token_counts(documents, name), containers.filter(F.col("tokenizer") == name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(_packed(spark, d), table(spark, d, "containers"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """With tasks so small that the tree has several levels at any size: whether all rules hold."""
    containers, documents, parts = table(spark, d, "containers"), table(spark, d, "documents"), []
    for (name,) in containers.select("tokenizer").distinct().orderBy("tokenizer").collect():  # a fixed table
        mine, n = containers.filter(F.col("tokenizer") == name), stage(tokenize.token_counts(documents, name), "counts")
        parts.append(packing.flaws(stage(packing.pack(n, mine, rows=256), "packed"), n, mine))
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.bands(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p2_recall, p6_ids, p6_counts, p6_decode, p7_containers, p7_summary, p7_check, p8_found)}

_NEAREST = """
  v AS (SELECT DISTINCT dataset_id, vid, CAST(pos AS DOUBLE[]) AS pos FROM vertices_nd JOIN root_metadata USING (dataset_id)
        WHERE pos IS NOT NULL AND len(pos) = ndim AND len(list_filter(pos, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  near AS (SELECT a.dataset_id, a.vid, b.vid AS neighbour, list_sum(list_transform(list_zip(a.pos, b.pos), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2,
                  row_number() OVER (PARTITION BY a.dataset_id, a.vid ORDER BY d2, b.vid) AS rank
           FROM v a JOIN v b ON a.dataset_id = b.dataset_id AND a.vid <> b.vid QUALIFY rank <= 10)
"""

SQL = {
    "p2_found": f"""WITH {_NEAREST} SELECT DISTINCT least(vid, neighbour) AS vid_a, greatest(vid, neighbour) AS vid_b FROM near""",
    "p2_neighbours": f"""WITH {_NEAREST} SELECT dataset_id, vid, CAST(rank AS INT) AS rank, neighbour, round(sqrt(d2), 6) AS distance FROM near""",
    "p2_recall": f"""WITH {_NEAREST} SELECT dataset_id, count(DISTINCT vid) AS n_queries, count(*) AS n_true, true AS enough FROM near WHERE vid % 100 = 0 GROUP BY 1""",
    "p6_counts": """SELECT unnest(['byte_bpe_50k', 'byte_bpe_multi_50k', 'word_bpe_49k', 'piece_bpe_32k']) AS tokenizer, n AS n_docs, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_made_up
        FROM (SELECT count(*) AS n FROM documents)""",
    "p7_check": """SELECT container_name, (SELECT count(*) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_lost, true AS near_least
        FROM containers WHERE capacity > 0""",
    "p6_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
