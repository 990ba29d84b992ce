"""Queries of digests, scores, selection and residency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, linear, rms_norm, rope, tidy
from ..operators import paging, sampling, scoring, selection
from .registry import query, table

H, D, P, SINK, WIN, K = 4, 16, 16, 2, 2, 4
#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 20
#: A fixed direction for projections, of unit length.
DIRECTION = [(i % 5 - 2) / 30**0.5 for i in range(D)]

TOK = """tok AS (SELECT vec_id, vec_id // 16 AS page_id, CAST((i - 1) // 16 AS INTEGER) AS head, (i - 1) % 16 AS dim,
    CAST(embedding[i] AS DOUBLE) AS k, CAST(embedding[65 - i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"""
SCORES = f"""{TOK},
    dig AS (SELECT page_id, head, dim, max(k) AS hi, min(k) AS lo FROM tok GROUP BY ALL),
    np AS (SELECT max(page_id) + 1 AS n FROM dig),
    sc AS (SELECT q.vec_id AS query_id, d.page_id, d.head, sum(greatest(q.k * hi, q.k * lo)) AS raw, round(raw, 6) + 0.0 AS score
        FROM tok q JOIN dig d USING (head, dim) WHERE q.vec_id % 20 = 0 GROUP BY ALL)"""
TOP = f"""{SCORES},
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY score DESC, page_id) AS rank FROM sc),
    sel AS (SELECT query_id, head, rank, page_id, score FROM rk WHERE rank <= 4)"""
SUMMED = f"""{SCORES},
    hs AS (SELECT query_id, page_id, round(sum(score), 6) + 0.0 AS score FROM sc GROUP BY ALL),
    ca AS (SELECT hs.* FROM hs, np WHERE page_id >= 2 AND page_id < n - 2),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM ca)"""

EXACT = f"""WITH {TOK}, sc AS (SELECT q.vec_id AS query_id, t.head, t.vec_id AS pos, round(sum(q.k * t.k), 6) + 0.0 AS score FROM tok q JOIN tok t USING (head, dim)
    WHERE q.vec_id % 20 = 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY score DESC, pos) AS rank FROM sc)
SELECT query_id, head, CAST(rank AS INTEGER) AS rank, pos, score FROM rk WHERE rank <= 10"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as one sequence: ``pos``, ``page_id``, ``head``, ``k``, ``v``."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return paging.split_heads(e, H, D).withColumn("page_id", paging.page_of(F.col("pos"), P))


def query_rows(toks: DataFrame) -> DataFrame:
    return toks.where(F.col("pos") % EVERY == 0).select(F.col("pos").alias("query_id"), "head", F.col("k").alias("q"))


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    return scoring.page_scores(query_rows(t), scoring.digests(t, D), D)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_scores(spark, sf_dir).withColumn("score", tidy(F.col("score")))


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("m"))
    return n.select((paging.page_of(F.col("m"), P) + 1).alias("n_pages"))


def summed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.head_sum(scores(spark, sf_dir)).withColumn("score", tidy(F.col("score")))
    return selection.candidates(s.join(F.broadcast(page_count(spark, sf_dir))), F.col("n_pages"), SINK, WIN).drop("n_pages")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_pages(scores(spark, sf_dir), K)


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Selections of each query but the first, and what is resident then: the one before's."""
    s = selected(spark, sf_dir)
    return s.where(F.col("query_id") >= EVERY), _moved_on(s.select("query_id", "head", "page_id"))


def _moved_on(chosen: DataFrame) -> DataFrame:
    """What each query chose, as resident when the next one comes."""
    ids = chosen.select("query_id").distinct()
    return chosen.withColumn("query_id", F.col("query_id") + EVERY).join(scoring.few(ids), "query_id", "left_semi")


@query(f"WITH {SCORES} SELECT page_id, head, CAST(dim AS INTEGER) AS dim, round(hi, 6) + 0.0 AS hi, round(lo, 6) + 0.0 AS lo FROM dig")
def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.digests(tokens(spark, sf_dir), D)
    rows = d.select("page_id", "head", F.posexplode(F.arrays_zip("hi", "lo")).alias("dim", "x"))
    return rows.select("page_id", "head", "dim", tidy(F.col("x.hi")).alias("hi"), tidy(F.col("x.lo")).alias("lo"))


@query(f"WITH {SCORES} SELECT page_id, head, CAST(dim AS INTEGER) AS dim, round(hi, 6) + 0.0 AS hi, round(lo, 6) + 0.0 AS lo FROM dig")
def page_digest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a first part of the rows, merged with those of the rows behind it."""
    t = tokens(spark, sf_dir)
    old, new = (scoring.digests(t.where(c), D) for c in (F.col("pos") < 230, F.col("pos") >= 230))
    rows = scoring.merge_digests(old, new, D).select("page_id", "head", F.posexplode(F.arrays_zip("hi", "lo")).alias("dim", "x"))
    return rows.select("page_id", "head", "dim", tidy(F.col("x.hi")).alias("hi"), tidy(F.col("x.lo")).alias("lo"))


@query(f"""WITH {TOK}, d AS (SELECT page_id, head, dim, max(k) AS hi, min(k) AS lo, bool_or(vec_id >= 230) AS changed FROM tok GROUP BY ALL)
SELECT page_id, head, changed, round(sum(hi), 6) + 0.0 AS hi, round(sum(lo), 6) + 0.0 AS lo FROM d GROUP BY ALL""")
def index_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after rows were inserted, with the pages that changed by it."""
    t = tokens(spark, sf_dir)
    got = scoring.insert(scoring.digests(t.where("pos < 230"), D), t.where("pos >= 230"), D)
    sum_ = lambda c: tidy(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return got.select("page_id", "head", "changed", sum_("hi").alias("hi"), sum_("lo").alias("lo"))


@query(f"WITH {SCORES} SELECT query_id, page_id, head, score FROM sc")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


@query(f"WITH {SCORES} SELECT query_id, page_id, CAST(head // 2 AS INTEGER) AS grp, round(avg(raw), 6) + 0.0 AS score FROM sc GROUP BY query_id, page_id, head // 2")
def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.group_mean(raw_scores(spark, sf_dir), 2).withColumn("score", tidy(F.col("score")))


@query(f"WITH {TOP} SELECT query_id, head, CAST(rank AS INTEGER) AS rank, page_id, score FROM sel")
def topk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir).select("query_id", "head", "rank", "page_id", "score")


@query(f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY score, page_id) AS rank FROM sc)
SELECT query_id, head, CAST(rank AS INTEGER) AS rank, page_id, score FROM rk WHERE rank <= 4""")
def bottomk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_pages(scores(spark, sf_dir), K, least=True).select("query_id", "head", "rank", "page_id", "score")


@query(EXACT)
def exact_topk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact nearest rows of each query and head, which indexed search is held against."""
    t = tokens(spark, sf_dir)
    got = selection.top_rows(query_rows(t), t, D, 10)
    return got.withColumn("score", tidy(F.col("score"))).select("query_id", "head", "rank", "pos", "score")


@query(f"""WITH {SUMMED} SELECT query_id, page_id, 'topk' AS kind FROM cr WHERE rank <= 4
UNION ALL SELECT q, p, CASE WHEN p < 2 THEN 'sink' ELSE 'window' END FROM (SELECT DISTINCT query_id AS q FROM sc), (SELECT DISTINCT page_id AS p FROM sc), np WHERE p < 2 OR p >= n - 2""")
def select_with_sink_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.top_pages(summed_candidates(spark, sf_dir), K, ("query_id",))
    n = page_count(spark, sf_dir)
    pages = n.select("n_pages", F.explode(F.expr("sequence(0L, n_pages - 1)")).alias("page_id"))
    return selection.with_kept_pages(best, query_rows(tokens(spark, sf_dir)), pages, SINK, WIN)


@query(f"""WITH {TOP}, f AS (SELECT query_id, CAST(head // 2 AS INTEGER) AS kv_head, page_id, min((rank - 1) * 2 + head % 2) AS place FROM sel GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kv_head ORDER BY place) AS rnk FROM f)
SELECT query_id, kv_head, CAST(rnk AS INTEGER) AS rnk, page_id FROM r WHERE rnk <= 4""")
def interleave_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.interleave_unique(selected(spark, sf_dir), 2, K).select("query_id", "kv_head", "rnk", "page_id")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS ord FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS rnk FROM f)
SELECT user_id, event_type, CAST(rnk AS INTEGER) AS rnk FROM r WHERE rnk <= 3""")
def first_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three kinds of event of each user, in order of appearance."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return selection.first_unique(e, "event_type", "event_id", 3, ("user_id",)).select("user_id", "event_type", "rnk")


STEP = f"""{TOP}, now AS (SELECT * FROM sel WHERE query_id >= 20), was AS (SELECT query_id + 20 AS query_id, head, page_id FROM sel WHERE query_id + 20 IN (SELECT query_id FROM sel)),
    rec AS (SELECT n.query_id, n.head, n.rank, n.page_id FROM now n LEFT JOIN was w USING (query_id, head, page_id) WHERE w.page_id IS NULL),
    evi AS (SELECT w.query_id, w.head, w.page_id FROM was w ANTI JOIN now n USING (query_id, head, page_id))"""


@query(f"""WITH {STEP} SELECT query_id, head, page_id FROM rec
UNION ALL SELECT n.query_id, n.head, n.page_id FROM now n SEMI JOIN was w USING (query_id, head, page_id) WHERE n.page_id % 5 = 0""")
def recall_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _steps(spark, sf_dir)
    changed = was.select("page_id").distinct().where("page_id % 5 = 0")
    return selection.recall_set(now, was, changed, ["query_id", "head", "page_id"]).select("query_id", "head", "page_id")


@query(f"WITH {STEP} SELECT query_id, head, page_id FROM evi")
def evict_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _steps(spark, sf_dir)
    return selection.evict_set(now, was, ["query_id", "head", "page_id"])


@query(f"WITH {STEP} SELECT query_id, head, count(*) AS n_recalled FROM rec GROUP BY ALL")
def recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _steps(spark, sf_dir)
    return selection.recall_set(now, was, None, ["query_id", "head", "page_id"]).groupBy("query_id", "head").agg(F.count("*").alias("n_recalled"))


@query(f"""WITH {STEP} SELECT r.query_id, r.head, r.page_id, t.vec_id % 16 AS slot, t.vec_id, round(t.k, 6) + 0.0 AS k0 FROM rec r JOIN tok t USING (head, page_id) WHERE t.dim = 0""")
def recall_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _steps(spark, sf_dir)
    on = ["query_id", "head", "page_id"]
    rows = selection.gather(selection.recall_set(now, was, None, on), tokens(spark, sf_dir), ["head", "page_id"])
    return rows.select("query_id", "head", "page_id", paging.slot_of(F.col("pos"), P).alias("slot"), F.col("pos").alias("vec_id"), tidy(F.col("k")[0]).alias("k0"))


@query(EXACT)
def digest_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows, sought in the pages whose bound leaves them a chance only."""
    t = tokens(spark, sf_dir)
    got = selection.pruned_top_rows(query_rows(t), t, D, 8, 10)
    return got.select("query_id", "head", "pos", tidy(F.col("score")).alias("score"), "rank")


@query(EXACT)
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows by way of an index: rows clustered into pages by projection, and those pages' digests."""
    t = tokens(spark, sf_dir)
    index = scoring.projection_pages(t.select("pos", "head", "k"), DIRECTION, P)
    got = selection.pruned_top_rows(query_rows(t), index, D, 8, 10)
    return got.select("query_id", "head", "pos", tidy(F.col("score")).alias("score"), "rank")


@query(f"""WITH {STEP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY rank) AS i FROM rec),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY page_id) AS i FROM evi),
    c AS (SELECT query_id, head, count(*) AS n FROM rec GROUP BY ALL),
    o AS (SELECT query_id, head, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM c)
SELECT query_id, head, r.page_id, e.page_id AS slot_page, CAST(offs + i - 1 AS BIGINT) AS transit_row FROM r JOIN e USING (query_id, head, i) JOIN o USING (query_id, head)""")
def scatter_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _steps(spark, sf_dir)
    on = ["query_id", "head", "page_id"]
    return selection.scatter(selection.recall_set(now, was, None, on), selection.evict_set(now, was, on), ["query_id", "head"])


@query(f"""WITH {SUMMED}, now AS (SELECT * FROM cr WHERE rank <= 4 AND query_id >= 20), was AS (SELECT query_id + 20 AS query_id, page_id FROM cr WHERE rank <= 4 AND query_id + 20 IN (SELECT query_id FROM cr)),
    ch AS (SELECT n.query_id, n.page_id, CASE WHEN w.page_id IS NULL THEN 'recall' ELSE 'hit' END AS action FROM now n LEFT JOIN was w USING (query_id, page_id)),
    nr AS (SELECT query_id, count(*) FILTER (action = 'recall') AS n FROM ch GROUP BY 1),
    vi AS (SELECT ca.query_id, ca.page_id, row_number() OVER (PARTITION BY ca.query_id ORDER BY score, ca.page_id) AS i FROM ca JOIN was USING (query_id, page_id))
SELECT * FROM ch UNION ALL SELECT query_id, page_id, 'victim' FROM vi JOIN nr USING (query_id) WHERE i <= n""")
def select_topk_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summed_candidates(spark, sf_dir)
    was = _moved_on(selection.top_pages(s, K, ("query_id",)).select("query_id", "page_id"))
    return selection.reconcile(s.where(F.col("query_id") >= EVERY), was, K)


@query(f"""WITH {SUMMED} SELECT query_id, page_id, page_id < 2 OR page_id >= n - 2 OR coalesce(rank <= 6, false) AS resident
FROM (SELECT DISTINCT query_id, page_id FROM sc) LEFT JOIN cr USING (query_id, page_id), np""")
def prefill_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summed_candidates(spark, sf_dir)
    q = query_rows(tokens(spark, sf_dir)).select("query_id").distinct()
    n = page_count(spark, sf_dir)
    pages = q.join(F.broadcast(n.select("n_pages", F.explode(F.expr("sequence(0L, n_pages - 1)")).alias("page_id"))))
    return selection.placement(pages, s, F.col("n_pages"), 6, SINK, WIN).select("query_id", "page_id", "resident")


@query(f"""WITH {TOP}, l AS (SELECT CAST(x AS INTEGER) AS layer, CAST(CASE WHEN x <= 2 OR (x - 2) % 3 = 0 THEN x ELSE x - (x - 2) % 3 END AS INTEGER) AS src FROM range(2, 6) r(x))
SELECT layer, query_id, page_id FROM l JOIN sel ON sel.head + 2 = src""")
def reused_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads' selections stand for those of layers 2 to 5; a layer takes its anchor's."""
    s = selected(spark, sf_dir).select((F.col("head") + 2).alias("layer"), "query_id", "page_id")
    layers = spark.range(2, 6).select(F.col("id").cast("int").alias("layer"))
    layers = layers.withColumn("anchor", paging.anchor_layer(F.col("layer"), F.lit(3)).cast("int"))
    return selection.reuse(s, layers).select("layer", "query_id", "page_id")


@query(f"""WITH {TOP} SELECT query_id, max(c) AS most, CAST(sum(c) AS BIGINT) AS total, count(DISTINCT c) = 1 AS even
FROM (SELECT query_id, head, count(*) FILTER (score > 0.25) AS c FROM sel GROUP BY ALL) GROUP BY query_id""")
def page_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = selected(spark, sf_dir).groupBy("query_id", "head").agg(F.sum((F.col("score") > 0.25).cast("long")).alias("c"))
    return c.groupBy("query_id").agg(F.max("c").alias("most"), F.sum("c").alias("total"), (F.min("c") == F.max("c")).alias("even"))


@query(f"""WITH {TOP}, l AS (SELECT CAST(x AS INTEGER) AS layer, CAST(CASE WHEN x <= 2 OR (x - 2) % 3 = 0 THEN x ELSE x - (x - 2) % 3 END AS INTEGER) AS src FROM range(2, 6) r(x))
SELECT layer, query_id, page_id + layer * 1000 AS page_id FROM l JOIN sel ON sel.head + 2 = src""")
def reused_selection_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where each layer numbers its pages from a start of its own."""
    s = selected(spark, sf_dir).select((F.col("head") + 2).alias("layer"), "query_id", "page_id")
    layers = spark.range(2, 6).select(F.col("id").cast("int").alias("layer"), (F.col("id") * 1000).alias("offset"))
    layers = layers.withColumn("anchor", paging.anchor_layer(F.col("layer"), F.lit(3)).cast("int"))
    return selection.reuse(s, layers).select("layer", "query_id", "page_id")


PROBS = f"""{SUMMED}, mx AS (SELECT query_id, max(score) AS m FROM hs GROUP BY 1), ex AS (SELECT query_id, page_id, exp(score - m) AS e FROM hs JOIN mx USING (query_id)),
    pr AS (SELECT query_id, page_id, e / sum(e) OVER (PARTITION BY query_id) AS p FROM ex)"""


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.head_sum(scores(spark, sf_dir)).withColumn("score", tidy(F.col("score")))
    top = s.groupBy("query_id").agg(F.max("score").alias("m"))
    e = s.join(top, "query_id").select("query_id", "page_id", F.exp(F.col("score") - F.col("m")).alias("e"))
    return e.join(e.groupBy("query_id").agg(F.sum("e").alias("z")), "query_id").select(F.col("query_id").alias("row_id"), F.col("page_id").alias("token_id"), (F.col("e") / F.col("z")).alias("p"))


def _uniform(i: Column) -> Column:
    """A fixed number between 0 and 1 for each whole one."""
    return (F.pmod(i * 37, F.lit(100)) + 0.5) / 100


@query(f"""WITH {PROBS}, cd AS (SELECT *, sum(p) OVER (PARTITION BY query_id ORDER BY page_id) AS c FROM pr)
SELECT query_id, coalesce(min(page_id) FILTER (c > ((query_id // 20 * 37) % 100 + 0.5) / 100), max(page_id)) AS page_id FROM cd GROUP BY query_id""")
def inverse_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir)
    draws = p.select("row_id").distinct().withColumn("u", _uniform(paging.int_div(F.col("row_id"), EVERY)))
    return sampling.inverse_cdf(p, draws).select(F.col("row_id").alias("query_id"), F.col("token_id").alias("page_id"))


@query(f"""WITH {PROBS}, cd AS (SELECT *, sum(p) OVER (PARTITION BY query_id ORDER BY page_id) AS c FROM pr), u AS (SELECT query_id // 20 * 3 + j AS d, query_id, ((query_id // 20 * 3 + j) * 37 % 100 + 0.5) / 100 AS u FROM (SELECT DISTINCT query_id FROM pr), range(0, 3) r(j))
SELECT CAST(d AS BIGINT) AS draw, coalesce(min(page_id) FILTER (c > u), max(page_id)) AS page_id FROM cd JOIN u USING (query_id) GROUP BY d""")
def parallel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many draws that share probability rows by row index."""
    p = _probs(spark, sf_dir)
    draws = p.select("row_id").distinct().select("row_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    draws = draws.select((paging.int_div(F.col("row_id"), EVERY) * 3 + F.col("j")).alias("draw"), "row_id").withColumn("u", _uniform(F.col("draw")))
    return sampling.inverse_cdf(p, draws).select("draw", F.col("token_id").alias("page_id"))


ROUNDS = 32
#: Rejection rounds in SQL: over the pivot draw, then accept or raise the pivot to what was drawn.
REJECT = """WITH RECURSIVE {probs}, q AS (SELECT query_id, list(page_id ORDER BY page_id) AS ids, list(p ORDER BY page_id) AS ps FROM pr GROUP BY 1),
    st AS (SELECT query_id, ids, ps, 0 AS r, 0.0::DOUBLE AS bar, 1.0::DOUBLE AS mass, 0::BIGINT AS pick, false AS ok FROM q
    UNION ALL SELECT query_id, ids, ps, r + 1, greatest(bar, ps[i]), m, i, {accept} FROM (
        SELECT *, coalesce(list_sum(list_filter(ps, lambda x: x > greatest(bar, ps[i]))), 0.0) AS m, len(list_filter(ps, lambda x: x > greatest(bar, ps[i]))) AS n FROM (
            SELECT *, coalesce(list_min(list_filter(range(1, len(ps) + 1), lambda j: list_sum([CASE WHEN x > bar THEN x ELSE 0.0 END FOR x IN ps[1:j]]) > u * mass)), len(ps)) AS i FROM (
                SELECT *, ((query_id // 20 * 31 + r * 17) % 97 + 0.5) / 97 AS u FROM st WHERE NOT ok AND r < 32 AND mass > 0)))),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS b FROM st)
SELECT query_id, ids[pick] AS token_id, ok AS success FROM z WHERE b = 1"""


def _draws(p: DataFrame) -> DataFrame:
    rounds = p.select("row_id").distinct().select("row_id", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round"))
    return rounds.withColumn("u", (F.pmod(paging.int_div(F.col("row_id"), EVERY) * 31 + F.col("round") * 17, F.lit(97)) + 0.5) / 97)


@query(REJECT.format(probs=PROBS, accept="n < 5"))
def topk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir)
    return sampling.top_k(p, _draws(p), 5).withColumnRenamed("row_id", "query_id")


@query(REJECT.format(probs=PROBS, accept="1 - m + 0.5 > 1 + 1e-5"))
def topp_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir)
    return sampling.top_p(p, _draws(p), 0.5).withColumnRenamed("row_id", "query_id")


@query(REJECT.format(probs=PROBS, accept="1 - m + (0.3 + 0.1 * (query_id // 20 % 5)) > 1 + 1e-5"))
def topp_sample_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with a nucleus of its own."""
    p = _probs(spark, sf_dir)
    mass = p.select("row_id").distinct().withColumn("mass", 0.3 + 0.1 * F.pmod(paging.int_div(F.col("row_id"), EVERY), F.lit(5)))
    return sampling.top_p(p, _draws(p), mass).withColumnRenamed("row_id", "query_id")


@query(f"WITH {PROBS} SELECT query_id, arg_max(page_id, (p, -page_id)) AS page_id FROM pr GROUP BY 1")
def greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.argmax(_probs(spark, sf_dir), "row_id").select(F.col("row_id").alias("query_id"), F.col("token_id").alias("page_id"))


ANGLE = "vec_id * pow(10000.0, -2.0 * (dim % 8) / 16)"
ROPE = """WITH t AS (SELECT vec_id, embedding AS e, CAST((i - 1) // 16 AS INTEGER) AS head, CAST((i - 1) % 16 AS INTEGER) AS dim, i FROM embeddings, range(1, 65) r(i))
SELECT vec_id, head, dim, round(CAST(e[i] AS DOUBLE) * cos({angle}) + CASE WHEN dim < 8 THEN -CAST(e[i + 8] AS DOUBLE) ELSE CAST(e[i - 8] AS DOUBLE) END * sin({angle}), 6) + 0.0 AS k FROM t"""


def _long(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    return df.select(*keys, F.posexplode(c).alias("dim", out)).withColumn(out, tidy(F.col(out)))


@query(ROPE.format(angle=ANGLE))
def rope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).select(F.col("pos").alias("vec_id"), "head", rope(F.col("k"), F.col("pos"), D).alias("r"))
    return _long(t, ["vec_id", "head"], "r", "k")


@query(ROPE.format(angle="(vec_id + 100) * pow(10000.0, -2.0 * (dim % 8) / 16) / 2.0"))
def rope_past_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rows already in the cache, and positions scaled."""
    t = tokens(spark, sf_dir).select(F.col("pos").alias("vec_id"), "head", rope(F.col("k"), F.col("pos"), D, scale=2.0, past=100).alias("r"))
    return _long(t, ["vec_id", "head"], "r", "k")


FLAT = "f AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), z AS (SELECT vec_id, sum(x * x) AS ss FROM f GROUP BY 1)"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {FLAT} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x / sqrt(ss / 64 + 1e-5) * (1 + dim / 64.0), 6) + 0.0 AS y FROM f JOIN z USING (vec_id)")
def rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = rms_norm(F.col("x"), [1 + i / 64 for i in range(64)])
    return _long(_flat(spark, sf_dir).select("vec_id", y.alias("n")), ["vec_id"], "n", "y")


@query(f"""WITH {TOK}, z AS (SELECT vec_id, head, sum(k * k) AS ss FROM tok GROUP BY ALL)
SELECT vec_id, head, CAST(dim AS INTEGER) AS dim, round(k / sqrt(ss / 16 + 1e-5) * (1 + dim / 16.0), 6) + 0.0 AS y FROM tok JOIN z USING (vec_id, head)""")
def head_rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each head's key normalised by itself, as models do that norm queries and keys per head."""
    y = rms_norm(F.col("k"), [1 + i / D for i in range(D)])
    return _long(tokens(spark, sf_dir).select(F.col("pos").alias("vec_id"), "head", y.alias("n")), ["vec_id", "head"], "n", "y")


@query(f"WITH {FLAT} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x / sqrt(ss), 6) + 0.0 AS y FROM f JOIN z USING (vec_id)")
def l2_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_flat(spark, sf_dir).select("vec_id", l2_normalize(F.col("x"), 64).alias("n")), ["vec_id"], "n", "y")


@query(f"""WITH {TOK} SELECT vec_id, head, round(sum(k * (dim % 5 - 2) / sqrt(30)), 6) + 0.0 AS proj FROM tok, (SELECT max(page_id) + 1 AS n FROM tok)
WHERE page_id >= 2 AND page_id < n - 2 GROUP BY vec_id, head""")
def key_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = selection.candidates(tokens(spark, sf_dir).join(F.broadcast(page_count(spark, sf_dir))), F.col("n_pages"), SINK, WIN)
    p = dot(F.col("k"), F.array(*map(F.lit, DIRECTION)), D)
    return t.select(F.col("pos").alias("vec_id"), "head", tidy(p).alias("proj"))


@query(f"""WITH {TOK} SELECT vec_id, head, CAST(j AS INTEGER) AS dim, round(sum(k * (((dim + 1) * (j + 2)) % 7 - 3) / 4.0), 6) + 0.0 AS y FROM tok, range(0, 4) r(j) GROUP BY vec_id, head, j""")
def linear_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = [[((i + 1) * (j + 2) % 7 - 3) / 4 for j in range(4)] for i in range(D)]
    t = tokens(spark, sf_dir).select(F.col("pos").alias("vec_id"), "head", linear(F.col("k"), matrix).alias("m"))
    return _long(t, ["vec_id", "head"], "m", "y")


@query(f"""WITH {TOK}, p AS (SELECT vec_id, head, sum(k * (dim % 5 - 2) / sqrt(30)) AS proj FROM tok GROUP BY ALL)
SELECT vec_id, head, (row_number() OVER (PARTITION BY head ORDER BY proj, vec_id) - 1) // 16 AS page_id FROM p""")
def projection_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows clustered into pages by projection instead of position."""
    t = tokens(spark, sf_dir).drop("page_id")
    return scoring.projection_pages(t, DIRECTION, P).select(F.col("pos").alias("vec_id"), "head", "page_id")


@query("SELECT CAST(label AS BIGINT) AS seq_id, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each sequence, which alone is needed for the next step."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("seq_id")).agg(F.max_by("vec_id", "vec_id").alias("vec_id"))
