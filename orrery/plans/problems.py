"""Queries of the general data-pipeline problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import cells, compaction, hierarchy, references
from orrery.plans import staging
from orrery.sources.tables import table

SMALL_TARGET = 16 << 10


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cells.hot_cells(table(spark, d, "vertices"), table(spark, d, "root_metadata"))


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    out = cells.cell_stats(table(spark, d, "vertices"), table(spark, d, "root_metadata"))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("centre") or c == "radius"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.found(table(spark, d, "vertices"), table(spark, d, "shard_index")).select("file_id", "issue")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues by group, with a target so small that there are many groups at any size."""
    out = compaction.found(table(spark, d, "vertices"), table(spark, d, "shard_index"), SMALL_TARGET)
    return out.groupBy("dataset_id", "level", "group_no", "issue").agg(F.count("*").alias("n_files"))


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compaction_plan(table(spark, d, "vertices"), table(spark, d, "shard_index"))


def p3_plan_many(spark: SparkSession, d: str) -> DataFrame:
    """With a target so small that there are many groups at any size."""
    return compaction.compaction_plan(table(spark, d, "vertices"), table(spark, d, "shard_index"), SMALL_TARGET)


def p3_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact(table(spark, d, "vertices"), table(spark, d, "shard_index"), staging.new_path(spark, "compacted"))


def _links(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "links": table(spark, d, "links").select(F.col("child_vid").alias("node"), F.col("parent_vid").alias("parent")),
        "object_index": table(spark, d, "object_index").select(F.col("oid").alias("node"), F.col("parent_oid").alias("parent")),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        hierarchy.cycles(hierarchy.build(links)).select(F.lit(name).alias("source"), F.col("node").alias("node_id"), "cycle_id")
        for name, links in _links(spark, d).items()
    ]
    return parts[0].unionByName(parts[1])


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [hierarchy.nodes(hierarchy.build(links, paths=True)).withColumn("source", F.lit(name)) for name, links in _links(spark, d).items()]
    out = parts[0].unionByName(parts[1])
    return out.withColumn("path", F.when(F.col("path").isNotNull(), F.concat_ws("/", F.col("path").cast("array<string>"))))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """As p4_nodes, with partitions so small that forests are merged over several levels at any size."""
    parts = [hierarchy.nodes(hierarchy.build(links, paths=True, rows=2048, merged=1 << 17)).withColumn("source", F.lit(name)) for name, links in _links(spark, d).items()]
    return parts[0].unionByName(parts[1]).withColumn("path", F.when(F.col("path").isNotNull(), F.concat_ws("/", F.col("path").cast("array<string>"))))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Descendants as intervals: those of a node have ranks above its own, up to last, in its tree."""
    parts = [hierarchy.ranks(links).withColumn("source", F.lit(name)) for name, links in _links(spark, d).items()]
    return parts[0].unionByName(parts[1]).select("source", "node_id", "root", "rank", "last")


def p4_whole(spark: SparkSession, d: str) -> DataFrame:
    parts = [hierarchy.whole(links)[0].withColumn("source", F.lit(name)) for name, links in _links(spark, d).items()]
    return parts[0].unionByName(parts[1]).withColumn("path", F.concat_ws("/", F.col("path").cast("array<string>")))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = [hierarchy.whole(links)[1].withColumn("source", F.lit(name)) for name, links in _links(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.geometry_broken(*[table(spark, d, t) for t in ("vertices", "root_metadata", "object_index", "cross_chunk_links", "groupings")])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_broken"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_cells, p3_found, p3_report, p3_plan, p3_plan_many, p3_rewrite, p4_found, p4_nodes, p4_merged, p4_descendants, p4_whole, p4_pairs, p5_found, p5_report)
}

_CELLS = """
  SELECT v.*, TRY_CAST(floor(CAST(x AS DOUBLE) / chunk_shape[1]) AS BIGINT) AS cx,
         TRY_CAST(floor(CAST(y AS DOUBLE) / chunk_shape[2]) AS BIGINT) AS cy,
         CASE WHEN ndim > 2 THEN TRY_CAST(floor(CAST(z AS DOUBLE) / chunk_shape[3]) AS BIGINT) END AS cz,
         concat_ws('.', TRY_CAST(floor(CAST(x AS DOUBLE) / chunk_shape[1]) AS BIGINT), TRY_CAST(floor(CAST(y AS DOUBLE) / chunk_shape[2]) AS BIGINT),
                   CASE WHEN ndim > 2 THEN TRY_CAST(floor(CAST(z AS DOUBLE) / chunk_shape[3]) AS BIGINT) END) AS chunk_key, ndim
  FROM vertices v JOIN root_metadata r USING (dataset_id)
  WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND (ndim = 2 OR (z IS NOT NULL AND isfinite(z)))
"""

def _manifest(target: int) -> str:
    """The plan, with every file that is held or listed; files without rows take no bytes."""
    return f"""
  held AS (SELECT file_id, min(dataset_id) AS dataset_id, min(level) AS level, count(*) AS n_rows FROM vertices WHERE file_id IS NOT NULL GROUP BY 1),
  listed AS (SELECT file_id, min(dataset_id) AS dataset_id, min(level) AS level, min(n_records) AS lo, max(n_records) AS hi,
                    max(nbytes) AS nbytes FROM shard_index WHERE file_id IS NOT NULL GROUP BY 1),
  first_file AS (SELECT vid, min(file_id) AS file_id FROM vertices WHERE vid IS NOT NULL AND file_id IS NOT NULL GROUP BY 1),
  every AS (SELECT file_id, dataset_id, level, n_rows, keep_rows, bytes, lo, hi, listed,
      CAST(floor(coalesce(sum(CASE WHEN n_rows > 0 THEN bytes ELSE 0 END) OVER (PARTITION BY dataset_id, level ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {target}) AS BIGINT) AS group_no
    FROM (SELECT file_id, coalesce(h.dataset_id, l.dataset_id) AS dataset_id, coalesce(h.level, l.level) AS level, coalesce(n_rows, 0) AS n_rows, lo, hi, l.file_id IS NOT NULL AS listed,
                 coalesce(k.keep_rows, 0) AS keep_rows, greatest(coalesce(nbytes, 16 * coalesce(n_rows, 0)), 0) AS bytes
          FROM held h FULL JOIN listed l USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS keep_rows FROM first_file GROUP BY 1) k USING (file_id))),
  plan AS (SELECT * FROM every WHERE n_rows > 0),
  issues AS (SELECT DISTINCT file_id, 'repeat' AS issue FROM (SELECT file_id, min(file_id) OVER (PARTITION BY vid) AS f FROM vertices) WHERE file_id > f
    UNION ALL SELECT file_id, CASE WHEN NOT listed THEN 'unlisted' WHEN n_rows = 0 THEN 'empty' ELSE 'count' END FROM every WHERE NOT listed OR n_rows = 0 OR lo <> n_rows OR hi <> n_rows)
"""


_WALK = """
  up AS (SELECT source, node, min(CASE WHEN parent <> -1 THEN parent END) AS parent FROM (
           SELECT 'links' AS source, child_vid AS node, parent_vid AS parent FROM links
           UNION ALL SELECT 'object_index', oid, parent_oid FROM object_index) WHERE node IS NOT NULL GROUP BY ALL),
  down AS (SELECT u.source, u.node, u.node AS root, 0 AS depth, CAST(u.node AS VARCHAR) AS path FROM (
             SELECT source, node FROM up WHERE parent IS NULL
             UNION SELECT a.source, a.parent FROM up a LEFT JOIN up b ON a.source = b.source AND a.parent = b.node WHERE a.parent IS NOT NULL AND b.node IS NULL) u
           UNION ALL
           SELECT d.source, u.node, d.root, d.depth + 1, d.path || '/' || u.node FROM down d JOIN up u ON u.source = d.source AND u.parent = d.node)
"""

_ABOVE = """
  above AS (SELECT source, node, parent AS a FROM up WHERE parent IS NOT NULL
            UNION SELECT v.source, v.node, u.parent FROM above v JOIN up u ON u.source = v.source AND u.node = v.a WHERE u.parent IS NOT NULL)
"""

_REFS = """
  refs AS (
    SELECT 'object_index' AS ref_table, manifest_id AS ref_id, CAST(pos - 1 AS INT) AS pos, dataset_id, level, e.chunk_key AS chunk_key, e.fragment AS key, written_at
    FROM (SELECT *, unnest(manifest) AS e, generate_subscripts(manifest, 1) AS pos FROM object_index) WHERE e.chunk_key IS NOT NULL
    UNION ALL SELECT 'cross_chunk_links', link_id, 0, dataset_id, level, '', src_vid, written_at FROM cross_chunk_links
    UNION ALL SELECT 'cross_chunk_links', link_id, 1, dataset_id, level + delta, '', dst_vid, written_at FROM cross_chunk_links
    UNION ALL SELECT 'groupings', member_id, 0, dataset_id, 0, '', oid, written_at FROM groupings),
  targets AS (
    SELECT 'object_index' AS ref_table, dataset_id, level, chunk_key, fragment AS key, count(*) FILTER (deleted_at IS NULL) AS alive, min(written_at) FILTER (deleted_at IS NULL) AS first_at
    FROM cell_rows GROUP BY ALL
    UNION ALL SELECT 'cross_chunk_links', dataset_id, level, '', vid, count(*) FILTER (deleted_at IS NULL), min(written_at) FILTER (deleted_at IS NULL) FROM vertices GROUP BY ALL
    UNION ALL SELECT 'groupings', dataset_id, 0, '', oid, count(*) FILTER (deleted_at IS NULL), min(written_at) FILTER (deleted_at IS NULL) FROM object_index GROUP BY ALL),
  broken AS (SELECT DISTINCT ref_table, ref_id, pos,
      CASE WHEN t.alive IS NULL THEN 'missing' WHEN t.alive = 0 THEN 'deleted' WHEN t.first_at > r.written_at THEN 'late' END AS reason,
      strftime(r.written_at, '%Y-%m') AS period
    FROM refs r LEFT JOIN targets t USING (ref_table, dataset_id, level, chunk_key, key) WHERE key IS NOT NULL)
"""

SQL = {
    "p1_found": f"""WITH c AS ({_CELLS}) SELECT dataset_id, chunk_key FROM c WHERE level = 0 GROUP BY 1, 2
        HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM c WHERE level = 0)""",
    "p1_cells": f"""WITH c AS (SELECT dataset_id, chunk_key, CAST(x AS DOUBLE) + 0.0 AS x, CAST(y AS DOUBLE) + 0.0 AS y,
            CASE WHEN ndim > 2 THEN CAST(z AS DOUBLE) + 0.0 END AS z FROM ({_CELLS}) WHERE level = 0),
        s AS (SELECT dataset_id, chunk_key, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
            CAST(sum(CAST(round(x * 1048576) AS HUGEINT)) AS DOUBLE) / (count(*) * 1048576.0) AS centre_x,
            CAST(sum(CAST(round(y * 1048576) AS HUGEINT)) AS DOUBLE) / (count(*) * 1048576.0) AS centre_y,
            CAST(sum(CAST(round(z * 1048576) AS HUGEINT)) AS DOUBLE) / (count(*) * 1048576.0) AS centre_z FROM c GROUP BY 1, 2),
        r AS (SELECT dataset_id, chunk_key, max(sqrt(power(x - centre_x, 2) + power(y - centre_y, 2) + coalesce(power(z - centre_z, 2), 0))) AS radius
            FROM c JOIN s USING (dataset_id, chunk_key) GROUP BY 1, 2)
        SELECT s.* REPLACE (round(centre_x, 4) + 0.0 AS centre_x, round(centre_y, 4) + 0.0 AS centre_y, round(centre_z, 4) + 0.0 AS centre_z), round(radius, 4) AS radius
        FROM s JOIN r USING (dataset_id, chunk_key)""",
    "p3_found": f"WITH {_manifest(128 << 20)} SELECT * FROM issues",
    "p3_report": f"WITH {_manifest(SMALL_TARGET)} SELECT dataset_id, level, group_no, issue, count(*) AS n_files FROM issues JOIN every USING (file_id) GROUP BY ALL",
    "p3_plan": f"WITH {_manifest(128 << 20)} SELECT file_id, dataset_id, level, group_no, n_rows, keep_rows, bytes FROM plan",
    "p3_plan_many": f"WITH {_manifest(SMALL_TARGET)} SELECT file_id, dataset_id, level, group_no, n_rows, keep_rows, bytes FROM plan",
    "p3_rewrite": f"""WITH {_manifest(128 << 20)} SELECT dataset_id, level, group_no, CAST(sum(n_rows) AS BIGINT) AS rows_in, CAST(sum(keep_rows) AS BIGINT) AS planned, CAST(sum(w) AS BIGINT) AS written
        FROM plan JOIN (SELECT file_id, count(vid) AS w FROM plan LEFT JOIN first_file USING (file_id) GROUP BY 1) USING (file_id) GROUP BY 1, 2, 3""",
    "p4_found": f"""WITH RECURSIVE {_WALK},
        loose AS (SELECT source, node, parent FROM up WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.source = up.source AND d.node = up.node)),
        step AS (SELECT source, node AS start, parent AS at, 1 AS n FROM loose
          UNION ALL SELECT s.source, s.start, l.parent, n + 1 FROM step s JOIN loose l ON l.source = s.source AND l.node = s.at
          WHERE s.at <> s.start AND n < 2000)
        SELECT s.source, s.start AS node_id, least(s.start, min(t.at)) AS cycle_id FROM step s JOIN step t ON t.source = s.source AND t.start = s.start
        WHERE s.at = s.start GROUP BY 1, 2""",
    "p4_nodes": f"""WITH RECURSIVE {_WALK},
        below AS (SELECT source, CAST(unnest(string_split(path, '/')) AS BIGINT) AS node, count(*) - 1 AS n FROM down GROUP BY 1, 2),
        loose AS (SELECT source, node, parent FROM up WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.source = up.source AND d.node = up.node)),
        step AS (SELECT source, node AS start, parent AS at, 1 AS n FROM loose
          UNION ALL SELECT s.source, s.start, l.parent, n + 1 FROM step s JOIN loose l ON l.source = s.source AND l.node = s.at
          WHERE s.at <> s.start AND n < 2000),
        ring AS (SELECT s.source, s.start AS node, least(s.start, min(t.at)) AS id FROM step s JOIN step t ON t.source = s.source AND t.start = s.start
          WHERE s.at = s.start GROUP BY 1, 2),
        lead AS (SELECT s.source, s.start AS node, min(r.id) AS id FROM step s JOIN ring r ON r.source = s.source AND (r.node = s.at OR r.node = s.start) GROUP BY 1, 2)
        SELECT source, node AS node_id, root, CAST(depth AS BIGINT) AS depth, CAST(n AS BIGINT) AS n_descendants, path, false AS on_cycle FROM down JOIN below USING (source, node)
        UNION ALL SELECT source, l.node, l.id, NULL, NULL, NULL, r.node IS NOT NULL FROM lead l LEFT JOIN ring r USING (source, node)""",
    "p4_descendants": f"""WITH RECURSIVE {_WALK}, walked AS (SELECT source, node, root, list_transform(string_split(path, '/'), lambda p: CAST(p AS BIGINT)) AS path FROM down),
        below AS (SELECT source, a, count(*) AS n FROM (SELECT source, unnest(path) AS a FROM walked) GROUP BY 1, 2),
        ranked AS (SELECT source, node, root, row_number() OVER (PARTITION BY source, root ORDER BY path) - 1 AS rank FROM walked)
        SELECT r.source, r.node AS node_id, root, rank, CAST(rank + n - 1 AS BIGINT) AS last FROM ranked r JOIN below b ON b.source = r.source AND b.a = r.node""",
    "p4_whole": f"""WITH RECURSIVE {_WALK}, {_ABOVE},
        ring AS (SELECT source, node FROM above WHERE a = node),
        cyc AS (SELECT source, node, min(a) AS cycle_id FROM above SEMI JOIN ring USING (source, node) GROUP BY 1, 2),
        cut AS (SELECT u.source, u.node, CASE WHEN r.node IS NULL THEN parent END AS p FROM up u LEFT JOIN ring r USING (source, node)),
        walk AS (SELECT t.source, t.node, t.node AS root, 0 AS depth, CAST(t.node AS VARCHAR) AS path FROM (SELECT source, node FROM cut WHERE p IS NULL
            UNION SELECT a.source, a.parent FROM up a LEFT JOIN up b ON a.source = b.source AND a.parent = b.node WHERE a.parent IS NOT NULL AND b.node IS NULL) t
          UNION ALL SELECT w.source, c.node, w.root, w.depth + 1, w.path || '/' || c.node FROM walk w JOIN cut c ON c.source = w.source AND c.p = w.node)
        SELECT w.source, w.node AS node_id, up.parent, w.root, cycle_id, CAST(depth AS BIGINT) AS depth, coalesce(n, 0) AS n_descendants, path, r.node IS NOT NULL AS on_cycle
        FROM walk w LEFT JOIN up USING (source, node) LEFT JOIN ring r USING (source, node) LEFT JOIN cyc ON cyc.source = w.source AND cyc.node = w.root
        LEFT JOIN (SELECT source, a, count(*) FILTER (a <> node) AS n FROM above GROUP BY 1, 2) b ON b.source = w.source AND b.a = w.node""",
    "p4_pairs": f"""WITH RECURSIVE {_WALK}, {_ABOVE} SELECT source, a AS ancestor, node AS descendant FROM above WHERE a <> node""",
    "p5_found": f"WITH cell_rows AS ({_CELLS}), {_REFS} SELECT ref_table, ref_id, pos, reason, period FROM broken WHERE reason IS NOT NULL",
    "p5_report": f"WITH cell_rows AS ({_CELLS}), {_REFS} SELECT ref_table, period, reason, count(*) AS n_broken FROM broken WHERE reason IS NOT NULL GROUP BY ALL",
}
SQL["p4_merged"] = SQL["p4_nodes"]
