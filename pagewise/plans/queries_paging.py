"""Queries of layout, budgets and append streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import ceil_div, power_of_two
from ..operators import paging
from ..session import shared_dir
from ..streaming.append import resident_pages, run_available
from .registry import query, table

P, BUDGET, SINK, WIN, RATIO = 16, 16, 2, 2, 2
EVENT_P, EVENT_BUDGET = 4, 8


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sequences by label: ``seq_id``, ``pos``, ``vec_id``, ``embedding``."""
    e = table(spark, sf_dir, "embeddings").withColumn("seq_id", F.col("label").cast("long"))
    return paging.positions(e, "seq_id", ["vec_id"]).select("seq_id", "pos", "vec_id", "embedding")


@query("SELECT vec_id, vec_id // 16 AS page_id, vec_id % 16 AS slot FROM embeddings")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", paging.page_of(F.col("vec_id"), P).alias("page_id"), paging.slot_of(F.col("vec_id"), P).alias("slot"))


@query("""SELECT CAST(label AS BIGINT) AS seq_id, count(*) AS n_rows, (count(*) + 15) // 16 AS n_pages, (count(*) - 1) % 16 + 1 AS last_page_len
FROM embeddings GROUP BY label""")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.seq_meta(table(spark, sf_dir, "embeddings"), "label", P)


@query("""WITH m AS (SELECT CAST(label AS BIGINT) AS seq_id, count(*) AS n FROM embeddings GROUP BY label)
SELECT seq_id, CAST(sum(n) OVER (ORDER BY seq_id) - n AS BIGINT) AS indptr_start, CAST(sum(n) OVER (ORDER BY seq_id) AS BIGINT) AS indptr_end FROM m""")
def ragged_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.indptr(paging.seq_meta(table(spark, sf_dir, "embeddings"), "label", P))


@query("SELECT CAST(label AS BIGINT) AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id FROM embeddings")
def paged_to_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).drop("embedding")
    meta = paging.seq_meta(rows, "seq_id", P)
    pages = paging.page_table(meta)
    ragged = paging.paged_to_ragged(paging.pooled(rows, pages, P), pages, meta, P)
    return ragged.select("seq_id", "pos", "vec_id")


@query("""WITH m AS (SELECT CAST(label AS BIGINT) AS seq_id, (count(*) + 15) // 16 AS n FROM embeddings GROUP BY label),
    s AS (SELECT seq_id, n, sum(n) OVER (ORDER BY seq_id) - n AS first FROM m)
SELECT seq_id, CAST(i AS BIGINT) AS page_ord, CAST(first + i AS BIGINT) AS pool_page_id FROM s, range(0, n) r(i)""")
def pool_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_table(paging.seq_meta(table(spark, sf_dir, "embeddings"), "label", P))


@query("""SELECT vec_id, CAST((label // 1) AS BIGINT) AS seq_id, n_before + row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
    (n_before + row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS page_ord,
    (n_before + row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 16 AS slot
FROM (SELECT *, (SELECT count(*) FROM embeddings x WHERE x.label = e.label AND x.vec_id < 400) AS n_before FROM embeddings e WHERE vec_id >= 400)""")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from 400 on as a second batch behind the first."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("seq_id"))
    meta = paging.seq_meta(e.where("vec_id < 400"), "seq_id", P)
    new = e.where("vec_id >= 400").withColumn("ord", F.col("vec_id"))
    return paging.append(meta, new, P).select("vec_id", "seq_id", F.col("pos").cast("long"), "page_ord", "slot")


@query("""SELECT CAST(q AS INTEGER) AS q_head, CAST(q // 2 AS INTEGER) AS kv_head, count(*) AS n_dims
FROM embeddings, range(0, 4) r(q), range(0, 16) d(i) GROUP BY q""")
def gqa_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = paging.split_heads(table(spark, sf_dir, "embeddings").select("embedding"), 4, 16)
    return heads.groupBy(F.col("head").alias("q_head")).agg(F.sum(F.size("k")).alias("n_dims")).select("q_head", paging.kv_head(F.col("q_head"), 4, 2).alias("kv_head"), "n_dims")


@query("""SELECT CAST(n AS INTEGER) AS n_reuse, CAST(l AS INTEGER) AS layer,
    CAST(CASE WHEN l <= 2 OR (l - 2) % n = 0 THEN 0 ELSE l - (l - 2) % n END AS INTEGER) AS anchor FROM range(1, 5) a(n), range(0, 32) b(l)""")
def reuse_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 5).select(F.col("id").cast("int").alias("n_reuse"))
    both = n.join(spark.range(32).select(F.col("id").cast("int").alias("layer")))
    return both.withColumn("anchor", paging.anchor_layer(F.col("layer"), F.col("n_reuse")).cast("int"))


SPLIT = """p AS (SELECT CAST(n AS BIGINT) AS n_pages, CASE WHEN n > 16 THEN least((n - 16) * 2, n - 4) ELSE 0 END AS n_off FROM range(1, 129) r(n)),
    b AS (SELECT *, CASE WHEN n_pages > 16 THEN least(n_off - (n_pages - 16), 12) ELSE 0 END AS n_indexed FROM p)"""


def _split(spark: SparkSession) -> DataFrame:
    n = spark.range(1, 129).select(F.col("id").alias("n_pages"))
    return n.withColumns(paging.budget_split(F.col("n_pages"), BUDGET, SINK, WIN, RATIO))


@query(f"WITH {SPLIT} SELECT n_pages, CAST(n_off AS BIGINT) AS n_off, CAST(n_indexed AS BIGINT) AS n_indexed, CAST(CASE WHEN n_pages > 16 THEN 16 - n_indexed - 2 ELSE 2 END AS BIGINT) AS n_win FROM b")
def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark)


@query(f"""WITH {SPLIT} SELECT n_pages, CAST(i AS BIGINT) AS page_id, n_pages > 16 AND i >= 2 AND i < 2 + n_off AS offloaded, n_pages <= 16 OR i < 2 OR i >= n_pages - 14 AS retained
FROM b, range(0, 128) r(i) WHERE i < n_pages""")
def retained_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark).select("n_pages", "n_off", F.explode(F.expr("sequence(0L, n_pages - 1)")).alias("page_id"))
    p, n = F.col("page_id"), F.col("n_pages")
    return rows.select("n_pages", "page_id", ((n > BUDGET) & (p >= SINK) & (p < SINK + F.col("n_off"))).alias("offloaded"), ((n <= BUDGET) | (p < SINK) | (p >= n - (BUDGET - SINK))).alias("retained"))


@query("""SELECT CAST(s AS BIGINT) AS step, CAST(greatest(2, 10 - s) AS BIGINT) AS n_win,
    CAST(16 - 2 - greatest(2, 10 - s) AS BIGINT) AS n_indexed, CAST(CASE WHEN greatest(2, 10 - s) = 2 THEN 1 WHEN greatest(2, 10 - s) - 1 >= 2 THEN 2 ELSE greatest(2, 10 - s) - 1 END AS BIGINT) AS n_evict FROM range(0, 21) r(s)""")
def window_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.range(21).withColumnRenamed("id", "step").withColumn("n_win", paging.window_after(F.col("step"), F.lit(10), WIN, RATIO).cast("long"))
    s = s.withColumn("n_indexed", BUDGET - SINK - F.col("n_win"))
    return s.withColumn("n_evict", paging.pages_evicted(F.col("n_win"), WIN, RATIO).cast("long"))


@query("SELECT CAST(w AS BIGINT) AS n_win, CAST(s AS BIGINT) AS step, CAST(16 - w + s % (w - 1) AS BIGINT) AS slot FROM range(2, 7) a(w), range(0, 12) b(s)")
def round_robin_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.range(2, 7).withColumnRenamed("id", "n_win").join(spark.range(12).withColumnRenamed("id", "step"))
    return both.withColumn("slot", paging.round_robin_slot(BUDGET, F.col("n_win"), F.col("step"), SINK).cast("long"))


@query("""WITH i AS (SELECT event_id AS id FROM events WHERE value < 20), r AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM i)
SELECT min(id) AS start_id, count(*) AS n FROM r GROUP BY g HAVING count(*) >= 3""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = table(spark, sf_dir, "events").where("value < 20")
    return paging.contiguous_runs(free, "event_id", 3)


@query("""WITH i AS (SELECT event_id AS id FROM events WHERE value < 20), r AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM i),
    a AS (SELECT min(first) AS first FROM (SELECT min(id) AS first FROM r GROUP BY g HAVING count(*) >= 3))
SELECT first + i AS page_id, CAST(i AS BIGINT) AS slot FROM a, range(0, 3) r(i)""")
def allocate_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages in a row from the free ones; it is an error if there are none."""
    first = paging.allocate_run(table(spark, sf_dir, "events").where("value < 20"), 3, "event_id")
    return spark.range(3).select((F.col("id") + first).alias("page_id"), F.col("id").alias("slot"))


@query("SELECT CAST(i AS BIGINT) AS id FROM range(0, 2500) r(i) WHERE i NOT IN (SELECT vec_id FROM embeddings WHERE label < 6)")
def free_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.free_ids(spark, 2500, table(spark, sf_dir, "embeddings").where("label < 6"), "vec_id")


@query("""SELECT CAST(l AS INTEGER) AS layer, CASE WHEN l >= 2 THEN 16 END AS budget, CASE WHEN l >= 2 THEN 8 END AS topk,
    CAST(1073741824 // (2 * 16 * 8 * 128 * 2) AS BIGINT) AS n_max_pages, CAST(pow(2, ceil(log2(l + 1))) AS BIGINT) AS capacity,
    CAST((l * 7 + 15) // 16 AS BIGINT) AS n_pages FROM range(0, 32) r(l)""")
def layer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = paging.layer_policy(spark, 32, BUDGET, None, 2)
    n = F.col("layer").cast("long")
    return policy.select("*", paging.bytes_to_pages(F.lit(1 << 30), 16, 8, 128, 2).alias("n_max_pages"), power_of_two(n + 1).alias("capacity"), ceil_div(n * 7, 16).alias("n_pages"))


@query("""WITH p AS (SELECT CAST(l AS INTEGER) AS layer, CAST(l * 3 AS BIGINT) AS n_pages FROM range(0, 32) r(l))
SELECT layer, n_pages, 16 AS budget, 8 AS topk FROM p WHERE layer >= 2 AND n_pages > 16""")
def sparse_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.range(32).select(F.col("id").cast("int").alias("layer"), (F.col("id") * 3).alias("n_pages"))
    return paging.eligible(pages, paging.layer_policy(spark, 32, BUDGET, None, 2))


@query("""WITH m AS (SELECT (count(*) + 15) // 16 AS n FROM embeddings GROUP BY label),
    c AS (SELECT CAST(z AS BIGINT) AS size, CAST(sum(ceil(n / z)) AS BIGINT) AS k FROM m, range(1, 1000) r(z) WHERE z <= (SELECT max(n) FROM m) GROUP BY z)
SELECT CAST(g AS BIGINT) AS grid, coalesce((SELECT min(size) FROM c WHERE k <= g), (SELECT max(size) FROM c)) AS pages_per_chunk,
    coalesce((SELECT min_by(k, size) FROM c WHERE k <= g), (SELECT max_by(k, size) FROM c)) AS n_chunks FROM range(1, 65) r(g)""")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = paging.seq_meta(table(spark, sf_dir, "embeddings"), "label", P)
    return paging.split_plan(meta, spark.range(1, 65).withColumnRenamed("id", "grid"))


def _event_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.seq_meta(table(spark, sf_dir, "events"), "user_id", EVENT_P)


@query("""WITH e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS page_id FROM events)
SELECT user_id, page_id, count(*) AS n_rows FROM e GROUP BY user_id, page_id""")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = paging.positions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return e.groupBy("user_id", paging.page_of(F.col("pos"), EVENT_P).alias("page_id")).agg(F.count("*").alias("n_rows"))


@query("""WITH m AS (SELECT user_id, (count(*) + 3) // 4 AS n FROM events GROUP BY user_id)
SELECT user_id, CAST(i AS BIGINT) AS page_id, CASE WHEN i < 2 THEN 'sink' WHEN i >= n - 2 THEN 'window' WHEN n > 8 THEN 'offloaded' ELSE 'resident' END AS kind
FROM m, range(0, n) r(i)""")
def event_window_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _event_meta(spark, sf_dir).select(F.col("seq_id").alias("user_id"), "n_pages", F.explode(F.expr("sequence(0L, n_pages - 1)")).alias("page_id"))
    p, n = F.col("page_id"), F.col("n_pages")
    kind = F.when(p < SINK, "sink").when(p >= n - WIN, "window").when(n > EVENT_BUDGET, "offloaded").otherwise("resident")
    return m.select("user_id", "page_id", kind.alias("kind"))


SLOTS = """WITH m AS (SELECT user_id, (count(*) + 3) // 4 AS n FROM events GROUP BY user_id),
    s AS (SELECT user_id, n, i, n - 8 AS ev, i - 5 AS j FROM m, range(0, least(n, 8)) r(i)),
    l AS (SELECT *, ev - 1 - (((ev - 1 - j) % 2) + 2) % 2 AS last FROM s)
SELECT user_id, CAST(i AS BIGINT) AS slot, CAST(CASE WHEN ev > 0 AND i = 7 THEN n - 1 WHEN ev > 0 AND j BETWEEN 0 AND 1 AND last >= 0 THEN 7 + last ELSE i END AS BIGINT) AS page_id FROM l"""


@query(SLOTS)
def event_resident_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of three pages, so that two slots take turns."""
    return paging.resident_slots(_event_meta(spark, sf_dir), EVENT_BUDGET, 3).withColumnRenamed("seq_id", "user_id")


@query("""WITH m AS (SELECT user_id, (count(*) + 3) // 4 AS n, (count(*) - 1) % 4 + 1 AS l FROM events GROUP BY user_id)
SELECT user_id, n AS n_pages, n >= 8 AND l = 4 AS due FROM m""")
def event_offload_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _event_meta(spark, sf_dir)
    return m.select(F.col("seq_id").alias("user_id"), "n_pages", paging.offload_due(F.col("n_pages"), F.col("last_page_len"), EVENT_BUDGET, EVENT_P).alias("due"))


@query(SLOTS)
def event_stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, by state per user; its files go to the session's shared folder."""
    e = table(spark, sf_dir, "events")
    at = f"{sf_dir}/events.parquet"
    files = [f for f in e.inputFiles() if not f.rstrip("/").endswith("events.parquet")]
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(at if files else f"{sf_dir}/events*.parquet")
    states = resident_pages(stream.select(F.col("user_id").alias("seq_id")), EVENT_P, EVENT_BUDGET, n_win=3)
    done = run_available(states, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    return done.select(F.col("seq_id").alias("user_id"), F.posexplode("slots").alias("slot", "page_id")).withColumn("slot", F.col("slot").cast("long"))
