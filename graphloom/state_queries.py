"""Registered queries of state that outlives a batch: keyed tables, claims, limits, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph, state
from .operators.keyed import KeyedTable
from .queries import FILES_SQL, ORACLE_SQL, REPOSITORIES_SQL, cut, files, fresh_path, query, repositories, table
from .streaming import ledger

BATCHES = 6


@query(f"""WITH d AS (SELECT event_id % 4000 AS "deliveryId", event_id, ts, event_id % {BATCHES} AS batch FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY "deliveryId" ORDER BY batch, ts, event_id) AS n FROM d)
SELECT CAST("deliveryId" AS VARCHAR) AS "deliveryId", event_id, batch FROM f WHERE n = 1""")
def ledger_dedup_segments(spark, sf_dir):
    """Batches of deliveries against the ids of all earlier ones, each batch's own put after it."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4000).cast("string").alias("deliveryId"), "event_id", "ts", (F.col("event_id") % BATCHES).alias("batch"))
    known, out = KeyedTable(spark, fresh_path(spark, "deliveries"), "deliveryId string", ["deliveryId"], fan=3), None
    for k in range(BATCHES):
        batch, earlier = rows.where(F.col("batch") == k), known.segments(before=k)
        fresh = cut(ledger.new_deliveries(batch, known.rows_of(batch, earlier) if earlier else None, ["ts", "event_id"]), "fresh")
        known.put(fresh, k)
        out = fresh if out is None else out.unionByName(fresh)
    return out.select("deliveryId", "event_id", "batch")


@query(ORACLE_SQL["file_upsert"])
def file_upsert_segments(spark, sf_dir):
    """The changes as one delta on a table of segments, merged when read."""
    columns = ["id", "path", "repositoryId", "parseState", "sizeBytes", "commitSha", "inboundEdgeCount"]
    held = KeyedTable(spark, fresh_path(spark, "files"), files(spark, sf_dir).select(*columns).schema, ["repositoryId", "path"])
    held.put(files(spark, sf_dir).where("id % 5 <> 0"), 0)
    fresh = files(spark, sf_dir).where("id % 3 = 0").select("id", "path", "repositoryId", (F.col("sizeBytes") * 2).alias("sizeBytes"))
    extra = files(spark, sf_dir).where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), F.concat(F.lit("new/"), "id").alias("path"), F.lit("r1").alias("repositoryId"), F.lit(5).cast("long").alias("sizeBytes"))
    held.upsert(fresh.unionByName(extra), state.FILE_COLUMNS)
    return held.snapshot().select("id", "path", "sizeBytes", "parseState")


@query(f"""WITH {REPOSITORIES_SQL}, c AS (SELECT id, indexStatus, id % 7 = 0 AS first, id % 5 = 0 AS second, indexStatus IN ('PENDING', 'FAILED', 'INDEXED') AS lockable FROM repositories)
SELECT id, CASE WHEN lockable AND (first OR second) THEN 'INDEXING' ELSE indexStatus END AS "indexStatus",
  (SELECT count(*) FILTER (lockable AND first) FROM c) AS "firstClaimed", (SELECT count(*) FILTER (lockable AND second AND NOT first) FROM c) AS "secondClaimed", CAST(0 AS BIGINT) AS "againClaimed" FROM c""")
def index_lock_claims(spark, sf_dir):
    """Two runs claim overlapping repositories by compare and set, then the first once more."""
    rows = repositories(spark, sf_dir).select("id", "indexStatus")
    held = KeyedTable(spark, fresh_path(spark, "locks"), rows.schema, ["id"])
    held.put(rows, 0)
    claims = [held.acquire_lock(F.col("id") % n == 0) for n in (7, 5, 7)]
    names = ("firstClaimed", "secondClaimed", "againClaimed")
    return held.snapshot().select("id", "indexStatus", *(F.lit(n).cast("long").alias(c) for n, c in zip(claims, names, strict=True)))


@query(f"""WITH {FILES_SQL} SELECT CASE WHEN repositoryId = 'r1' THEN id + 5000000 ELSE id END AS id, repositoryId AS "repositoryId", path, CASE WHEN repositoryId = 'r1' THEN 'new' ELSE commitSha END AS "commitSha"
FROM files WHERE repositoryId = 'r0' OR id % 3 <> 0""")
def repository_replaced_segments(spark, sf_dir):
    """All rows of a repository by those of another commit, in one version."""
    rows = files(spark, sf_dir).select("id", "repositoryId", "path", "commitSha")
    held = KeyedTable(spark, fresh_path(spark, "files"), rows.schema, ["repositoryId", "path"])
    held.put(rows, 0)
    own = F.col("repositoryId") == "r1"
    held.replace(own, rows.where(own & (F.col("id") % 3 != 0)).withColumns({"id": F.col("id") + 5000000, "commitSha": F.lit("new")}))
    return held.snapshot()


@query("""WITH RECURSIVE n AS (SELECT max(doc_id) AS top FROM documents),
e AS (SELECT doc_id AS source, doc_id + 1 AS target FROM documents UNION SELECT doc_id, doc_id + 2 FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, doc_id - 40 FROM documents WHERE doc_id % 50 = 41),
w(seed, node, depth) AS (SELECT top - k * 150, top - k * 150, 0 FROM n, range(3) t(k) UNION SELECT seed, source, depth + 1 FROM w JOIN e ON e.target = w.node WHERE depth < 400)
SELECT seed, node AS "fileId", CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth > 0 GROUP BY seed, node""")
def importers_deep(spark, sf_dir):
    """Depth 400 over a chain of all files with shortcuts and cycles."""
    from .operators.walks import walk_importers

    docs = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    step = lambda rows, by: rows.select(F.lit("r").alias("repositoryId"), F.lit("IMPORTS").alias("kind"), i.alias("fromFileId"), (i + by).alias("toFileId"))
    edges = step(docs, 1).unionByName(step(docs.where(i % 3 == 0), 2)).unionByName(step(docs.where(i % 50 == 41), -40))
    seeds = docs.agg(F.max("doc_id").alias("top")).select(F.explode(F.array(*(F.col("top") - 150 * k for k in range(3)))).alias("seed"))
    return walk_importers(edges, "r", seeds, 400, cut)


@query("""WITH p AS (SELECT p_partkey AS "patternId", CASE p_partkey % 4 WHEN 0 THEN upper(substr(p_name, 2, 5)) WHEN 1 THEN substr(p_name, 4, 9) WHEN 2 THEN substr(p_name, 1, 2) ELSE 'zzq' || p_partkey END AS pattern FROM part WHERE p_partkey % 20 = 0 OR p_partkey < 12)
SELECT "patternId", p_partkey AS id FROM p JOIN part ON contains(lower(p_name), lower(pattern))""")
def search_postings(spark, sf_dir):
    """Parts of the names of every twentieth part and the first ones, in other cases, against all names."""
    from .operators.search import SearchIndex

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    k = F.col("id") % 4
    pattern = F.when(k == 0, F.upper(F.substring("name", 2, 5))).when(k == 1, F.substring("name", 4, 9)).when(k == 2, F.substring("name", 1, 2)).otherwise(F.concat(F.lit("zzq"), "id"))
    index = SearchIndex(spark, fresh_path(spark, "postings"), "id", "name")
    index.build(rows)
    return index.search(rows, rows.where("id % 20 = 0 OR id < 12").select(F.col("id").alias("patternId"), pattern.alias("pattern")))


@query(ORACLE_SQL["keyset_page"])
def keyset_page_files(spark, sf_dir):
    """The page out of the two or so files of 32 that it can be in."""
    from .operators.pages import read_page, write_pages

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("createdAt"))
    folder = fresh_path(spark, "pages")
    write_pages(rows, folder)
    return read_page(spark, folder, rows.schema, 20, (F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.lit(5000)))
