"""Queries of softmax-weighted sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import alibi_slope, tidy, tidy_by_arithmetic
from ..operators import attention, paging, scoring, selection
from .queries_paging import sequences
from .queries_selection import SCORES, SINK, SUMMED, TOK, WIN, D, H, K, P, query_rows, select_with_sink_window, tokens
from .queries_selection import scores as page_bounds
from .registry import query

LOGITS = "sum(q.k * t.k) / sqrt(16)"
STATE = """m AS (SELECT {by}, max(s) AS m FROM lg GROUP BY ALL),
    w AS (SELECT lg.*, pow(2.0, s - m) AS w, m FROM lg JOIN m USING ({by})),
    st AS (SELECT {by}, t.dim, sum(w * t.v) / sum(w) AS o, max(m) + log2(sum(w)) AS lse FROM w JOIN tok t USING (vec_id, head) GROUP BY ALL)"""
OUT = "SELECT query_id, head, CAST(dim AS INTEGER) AS dim, round(o, 6) + 0.0 AS o, round(lse, 6) + 0.0 AS lse FROM st"


def _sql(where: str = "true", bias: str = "", join: str = "") -> str:
    lg = f"""lg AS (SELECT q.vec_id AS query_id, t.vec_id, t.head, ({LOGITS}{bias}) * log2(exp(1)) AS s FROM tok q JOIN tok t USING (head, dim) {join}
    WHERE q.vec_id % 20 = 0 AND {where} GROUP BY q.vec_id, t.vec_id, t.head)"""
    return f"{lg}, {STATE.format(by='query_id, head')} {OUT}"


def _out(states: DataFrame) -> DataFrame:
    rows = attention.explode_o(states, ["query_id", "head"], F.col("s").alias("lse"))
    return rows.select("query_id", "head", "dim", tidy(F.col("o")).alias("o"), tidy(F.col("lse")).alias("lse"))


@query(f"WITH {TOK}, {_sql()}")
def decode_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    return _out(attention.attend(query_rows(t), t, D))


@query(f"WITH {TOK}, {_sql('t.vec_id % 16 < 16 - (t.vec_id // 16) % 3')}")
def decode_attention_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which only the first rows are valid."""
    t = tokens(spark, sf_dir)
    valid = paging.slot_of(F.col("pos"), P) < P - F.pmod(F.col("page_id"), F.lit(3))
    return _out(attention.attend(query_rows(t), t, D, keep=valid))


@query(f"""WITH {TOK}, qq AS (SELECT vec_id, CAST(h AS INTEGER) AS head, h // 2 AS kv, dim, k FROM tok JOIN range(0, 4) r(h) ON head = h WHERE vec_id % 20 = 0),
    lg AS (SELECT q.vec_id AS query_id, t.vec_id, q.head, q.kv, {LOGITS} * log2(exp(1)) AS s FROM qq q JOIN tok t ON t.head = q.kv AND t.dim = q.dim GROUP BY ALL),
    m AS (SELECT query_id, head, max(s) AS m FROM lg GROUP BY ALL), w AS (SELECT lg.*, pow(2.0, s - m) AS w, m FROM lg JOIN m USING (query_id, head)),
    st AS (SELECT w.query_id, w.head, t.dim, sum(w * t.v) / sum(w) AS o, max(m) + log2(sum(w)) AS lse FROM w JOIN tok t ON t.vec_id = w.vec_id AND t.head = w.kv GROUP BY ALL) {OUT}""")
def grouped_query_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four query heads over the first two key heads."""
    t = tokens(spark, sf_dir)
    q = query_rows(t).withColumn("kv", paging.kv_head(F.col("head"), H, H // 2))
    rows = t.where("head < 2").withColumnRenamed("head", "kv")
    return _out(attention.attend(q, rows, D, on=("kv",)))


BIAS = " + pow(2.0, -8.0 * (t.head + 1) / 4) * (t.vec_id - q.vec_id)"


@query(f"WITH {TOK}, {_sql(bias=BIAS)}")
def alibi_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    return _out(attention.attend(query_rows(t), t, D, slope=alibi_slope(F.col("head"), H)))


@query(f"""WITH {TOK}, sq AS (SELECT vec_id, CAST(label AS BIGINT) AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
    tk AS (SELECT tok.*, seq_id, pos FROM tok JOIN sq USING (vec_id)),
    lg AS (SELECT q.seq_id, q.pos AS qpos, t.pos AS kpos, t.head, {LOGITS} * log2(exp(1)) AS s FROM tk q JOIN tk t ON q.seq_id = t.seq_id AND q.head = t.head AND q.dim = t.dim AND t.pos <= q.pos GROUP BY ALL),
    m AS (SELECT seq_id, qpos, head, max(s) AS m FROM lg GROUP BY ALL), w AS (SELECT lg.*, pow(2.0, s - m) AS w FROM lg JOIN m USING (seq_id, qpos, head))
SELECT w.seq_id, w.qpos AS pos, w.head, CAST(t.dim AS INTEGER) AS dim, round(sum(w * t.v) / sum(w), 6) + 0.0 AS o
FROM w JOIN tk t ON t.seq_id = w.seq_id AND t.pos = w.kpos AND t.head = w.head GROUP BY ALL""")
def causal_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paging.split_heads(sequences(spark, sf_dir).drop("vec_id"), H, D)
    done = attention.causal(rows, D)
    return attention.explode_o(done, ["seq_id", "pos", "head"]).withColumn("o", tidy(F.col("o")))


SEQ = """sq AS (SELECT vec_id, CAST(label AS BIGINT) AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    tk AS (SELECT tok.*, seq_id, pos, n FROM tok JOIN sq USING (vec_id))"""


def _ragged(where: str) -> str:
    return f"""WITH {TOK}, {SEQ}, lg AS (SELECT q.seq_id, q.pos AS qpos, t.pos AS kpos, t.head, {LOGITS} * log2(exp(1)) AS s
        FROM tk q JOIN tk t ON q.seq_id = t.seq_id AND q.head = t.head AND q.dim = t.dim AND t.pos <= q.pos WHERE {where} GROUP BY ALL),
    m AS (SELECT seq_id, qpos, head, max(s) AS m FROM lg GROUP BY ALL), w AS (SELECT lg.*, pow(2.0, s - m) AS w, m FROM lg JOIN m USING (seq_id, qpos, head))
SELECT w.seq_id, w.qpos AS pos, w.head, CAST(t.dim AS INTEGER) AS dim, round(sum(w * t.v) / sum(w), 6) + 0.0 AS o, round(max(m) + log2(sum(w)), 6) + 0.0 AS lse
FROM w JOIN tk t ON t.seq_id = w.seq_id AND t.pos = w.kpos AND t.head = w.head GROUP BY ALL"""


def _of_sequences(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    """The last rows of each sequence over all rows of it up to themselves."""
    rows = paging.split_heads(sequences(spark, sf_dir).drop("vec_id"), H, D)
    n = paging.seq_meta(rows.where("head = 0"), "seq_id", P).select("seq_id", "n_rows")
    q = rows.join(n, "seq_id").where(F.col("pos") >= F.col("n_rows") - last).select("seq_id", "head", F.col("pos").alias("q_pos"), F.col("k").alias("q"))
    pairs = attention.logits(q, rows, D, on=("seq_id", "head"), keep=F.col("pos") <= F.col("q_pos"))
    by = ["seq_id", "q_pos", "head"]
    got = attention.explode_o(attention.states(pairs, by, D), by, F.col("s").alias("lse"))
    return got.select("seq_id", F.col("q_pos").alias("pos"), "head", "dim", tidy(F.col("o")).alias("o"), tidy(F.col("lse")).alias("lse"))


@query(_ragged("q.pos = q.n - 1"))
def ragged_decode_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of sequences of different lengths, one query row each."""
    return _of_sequences(spark, sf_dir, 1)


@query(_ragged("q.pos >= q.n - 5"))
def append_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five new rows of each sequence over what was there and each other."""
    return _of_sequences(spark, sf_dir, 5)


@query(_ragged("q.pos >= q.n - 5"))
def cascade_append_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two levels: a prefix of two pages, and what follows it; their states merge."""
    rows = paging.split_heads(sequences(spark, sf_dir).drop("vec_id"), H, D)
    n = paging.seq_meta(rows.where("head = 0"), "seq_id", P).select("seq_id", "n_rows")
    q = rows.join(n, "seq_id").where(F.col("pos") >= F.col("n_rows") - 5).select("seq_id", "head", F.col("pos").alias("q_pos"), F.col("k").alias("q"))
    by = ["seq_id", "q_pos", "head"]
    level = lambda c: attention.states(attention.logits(q, rows.where(c), D, on=("seq_id", "head"), keep=F.col("pos") <= F.col("q_pos")), by, D)
    both = attention.merge_two(level(F.col("pos") < 2 * P), level(F.col("pos") >= 2 * P), by, D)
    got = attention.explode_o(both, by, F.col("s").alias("lse"))
    return got.select("seq_id", F.col("q_pos").alias("pos"), "head", "dim", tidy(F.col("o")).alias("o"), tidy(F.col("lse")).alias("lse"))


@query(f"""WITH {TOK}, lg AS (SELECT q.vec_id AS query_id, t.vec_id, t.page_id, t.head, {LOGITS} * log2(exp(1)) AS s FROM tok q JOIN tok t USING (head, dim) WHERE q.vec_id % 20 = 0 GROUP BY ALL),
    m AS (SELECT query_id, head, page_id, max(s) AS m FROM lg GROUP BY ALL)
SELECT query_id, head, page_id, round(max(m) + log2(sum(pow(2.0, s - m))), 6) + 0.0 AS s, round(sum(pow(2.0, s - m) * t.v) / sum(pow(2.0, s - m)), 6) + 0.0 AS v0
FROM lg JOIN m USING (query_id, head, page_id) JOIN (SELECT vec_id, head, v FROM tok WHERE dim = 0) t USING (vec_id, head) GROUP BY query_id, head, page_id""")
def partial_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    return attention.page_states(query_rows(t), t, D, wide=1).select("query_id", "head", "page_id", tidy_by_arithmetic(F.col("s")).alias("s"), tidy_by_arithmetic(F.col("o")[0]).alias("v0"))


@query(f"WITH {TOK}, {_sql()}")
def merge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all pages merged: as without pages."""
    t = tokens(spark, sf_dir)
    return _out(attention.merged_pages(query_rows(t), t, D))


@query(f"WITH {TOK}, {_sql()}")
def merge_two_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages and odd pages."""
    t = tokens(spark, sf_dir)
    q = query_rows(t)
    a, b = (attention.merged_pages(q, t.where(F.col("page_id") % 2 == r), D) for r in (0, 1))
    return _out(attention.merge_two(a, b, ["query_id", "head"], D))


@query(f"WITH {TOK}, {_sql()}")
def cascade_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared prefix of eight pages, and what follows it."""
    by = ["query_id", "head"]
    t = tokens(spark, sf_dir)
    q = query_rows(t)
    prefix, suffix = (attention.attend(q, t.where(c), D) for c in (F.col("page_id") < 8, F.col("page_id") >= 8))
    return _out(attention.merge_states(prefix.unionByName(suffix), by, D))


@query(f"""WITH {SUMMED}, pg AS (SELECT query_id, page_id FROM cr WHERE rank <= 4 UNION SELECT q, p FROM (SELECT DISTINCT query_id AS q FROM sc), (SELECT DISTINCT page_id AS p FROM sc), np WHERE p < 2 OR p >= n - 2),
    {_sql("(q.vec_id, t.page_id) IN (SELECT (query_id, page_id) FROM pg)")}""")
def sparse_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the selected, first and last pages only."""
    t = tokens(spark, sf_dir)
    q = query_rows(t).join(select_with_sink_window(spark, sf_dir).drop("kind"), "query_id")
    return _out(attention.states(attention.logits(q, t, D, on=("head", "page_id")), ["query_id", "head"], D, few_groups=scoring.are_few(q)))


@query("""SELECT vec_id AS query_id, CAST(h AS INTEGER) AS head, CAST(d AS INTEGER) AS dim, 0.0::DOUBLE AS o, -50000.0::DOUBLE AS lse FROM embeddings, range(0, 4) b(h), range(0, 16) c(d) WHERE vec_id % 20 = 0""")
def empty_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over no rows at all."""
    t = tokens(spark, sf_dir)
    q = query_rows(t)
    got = attention.attend(q, t.where("page_id < 0"), D)
    return _out(attention.with_empty(got, q, ["query_id", "head"], D))


@query(f"""WITH {SCORES}, cand AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY score DESC, page_id) AS rank FROM sc WHERE page_id >= 2 AND page_id < query_id // 16 - 1),
    pg AS (SELECT query_id, head, page_id FROM cand WHERE rank <= 4
        UNION SELECT query_id, head, page_id FROM sc WHERE page_id <= query_id // 16 AND (page_id < 2 OR page_id >= query_id // 16 - 1)),
    {_sql("(q.vec_id, t.head, t.page_id) IN (SELECT (query_id, head, page_id) FROM pg) AND t.vec_id <= q.vec_id")}""")
def decode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a generation: each query is a new row that sees the rows up to itself, of which it
    takes the first and last pages and the best of the complete ones between, and attends to these."""
    t = tokens(spark, sf_dir)
    q = query_rows(t)
    n_pages = paging.page_of(F.col("query_id"), P) + 1
    between = selection.candidates(page_bounds(spark, sf_dir), n_pages, SINK, WIN)
    best = selection.top_pages(between, K).select("query_id", "head", "page_id")
    page = F.explode(F.expr(f"filter(sequence(0L, n_pages - 1), p -> p < {SINK} OR p >= n_pages - {WIN})")).alias("page_id")
    always = q.withColumn("n_pages", n_pages).select("query_id", "head", page)
    chosen = q.join(best.unionByName(always), ["query_id", "head"])
    pairs = attention.logits(chosen, t, D, on=("head", "page_id"), keep=F.col("pos") <= F.col("query_id"))
    return _out(attention.states(pairs, ["query_id", "head"], D, few_groups=scoring.are_few(q)))
