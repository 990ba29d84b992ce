"""Worked examples, edge cases and properties of the operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.functions import vectors
from pagewise.model import EngineConfig
from pagewise.operators import attention, paging, sampling, scoring, selection
from pagewise.plans.store import PagedStore
from pagewise.streaming.append import grow, resident_pages


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def tokens(n=50, heads=2, dim=4, seqs=1, seed=0):
    rng = np.random.default_rng(seed)
    return [(s, p, h, rng.normal(size=dim).tolist(), rng.normal(size=dim).tolist()) for s in range(seqs) for p in range(n) for h in range(heads)]


TOK = "seq_id long, pos long, head int, k array<double>, v array<double>"


def brute_attention(q, rows):
    z = np.array([np.dot(q, r[3]) for r in rows]) / math.sqrt(len(q)) * math.log2(math.e)
    w = 2 ** (z - z.max())
    return z.max() + math.log2(w.sum()), (w[:, None] * np.array([r[4] for r in rows])).sum(0) / w.sum()


@pytest.mark.parametrize("page_size", [1, 3, 7, 16])
def test_pages_at_their_edges(spark, page_size):
    for n in {1, page_size - 1, page_size, page_size + 1, 3 * page_size} - {0}:
        assert one(spark, paging.pages_for(F.lit(n), page_size)) == -(-n // page_size)
        assert one(spark, paging.last_page_len(F.lit(n), page_size)) == (n - 1) % page_size + 1
    assert one(spark, paging.last_page_len(F.lit(0), page_size)) == 0
    rows = spark.createDataFrame([(s, p) for s, n in ((0, 1), (2, page_size), (5, page_size + 1), (9000, 2)) for p in range(n)], "seq_id long, pos long")
    meta = paging.seq_meta(rows, "seq_id", page_size)
    table = paging.page_table(meta)
    ids = sorted(r["pool_page_id"] for r in table.collect())
    assert ids == list(range(len(ids)))
    back = paging.paged_to_ragged(paging.pooled(rows, table, page_size), table, meta, page_size)
    assert sorted(map(tuple, back.select("seq_id", "pos").collect())) == sorted(map(tuple, rows.collect()))


def test_budget_split(spark):
    for n, want in ((20, (8, 4, 10)), (64, (60, 12, 2)), (16, (0, 0, 2)), (17, (2, 1, 13))):
        c = paging.budget_split(F.lit(n), 16, 2, 2, 2)
        assert tuple(one(spark, c[k]) for k in ("n_off", "n_indexed", "n_win")) == want


def test_windows_and_slots(spark):
    assert [one(spark, paging.window_after(F.lit(s), F.lit(10), 2, 2)) for s in (0, 1, 8, 20)] == [10, 9, 2, 2]
    assert [one(spark, paging.round_robin_slot(16, F.lit(3), F.lit(c), 2)) for c in range(3)] == [13, 14, 13]
    assert {one(spark, paging.round_robin_slot(16, F.lit(2), F.lit(c), 2)) for c in range(3)} == {14}
    assert [one(spark, paging.anchor_layer(F.lit(i), F.lit(3))) for i in range(9)] == [0, 0, 0, 2, 2, 0, 5, 5, 0]
    assert one(spark, vectors.power_of_two(F.lit(5))) == 8 and one(spark, vectors.power_of_two(F.lit(8))) == 8


def test_interleave(spark):
    ranked = spark.createDataFrame([(0, h, r + 1, p) for h, ps in enumerate(([5, 7, 9], [7, 2, 5])) for r, p in enumerate(ps)], "query_id long, head int, rank int, page_id long")
    got = selection.interleave_unique(ranked, 2, 3).orderBy("rnk").collect()
    assert [r["page_id"] for r in got] == [5, 7, 2]


def test_scatter_offsets(spark):
    rec = spark.createDataFrame([(0, 0, 1, 10), (0, 0, 2, 11), (0, 2, 1, 12)], "query_id long, head int, rank int, page_id long")
    ev = spark.createDataFrame([(0, 0, 3), (0, 0, 1), (0, 2, 8), (0, 1, 4)], "query_id long, head int, page_id long")
    got = {r["page_id"]: (r["slot_page"], r["transit_row"]) for r in selection.scatter(rec, ev, ["query_id", "head"]).collect()}
    assert got == {10: (1, 0), 11: (3, 1), 12: (8, 2)}


def test_reconcile(spark):
    s = spark.createDataFrame([(0, p, float(x)) for p, x in enumerate([9, 1, 8, 2, 7, 3, 6]) if 1 <= p <= 6], "query_id long, page_id long, score double")
    res = spark.createDataFrame([(0, 2), (0, 3), (0, 5)], "query_id long, page_id long")
    assert {(r["page_id"], r["action"]) for r in selection.reconcile(s, res, 2).collect()} == {(2, "hit"), (4, "recall"), (3, "victim")}


def test_ties_take_the_lower_page(spark):
    s = spark.createDataFrame([(0, 0, p, 1.0) for p in range(6)], "query_id long, head int, page_id long, score double")
    assert sorted(r["page_id"] for r in selection.top_pages(s, 3).collect()) == [0, 1, 2]
    assert selection.top_pages(s, 99).count() == 6


def test_runs_across_spans(spark):
    ids = list(range(4090, 4100)) + [5, 6, 9000] + list(range(8190, 8193))
    got = sorted(map(tuple, paging.contiguous_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect()))
    assert got == [(5, 2), (4090, 10), (8190, 3), (9000, 1)]


def test_prefix_sums_across_spans(spark):
    df = spark.createDataFrame([(i * 1000, i) for i in range(50)], "k long, v long")
    assert {r["k"]: r["s"] for r in paging.prefix_sum(df, "k", "v", "s").collect()} == {i * 1000: i * (i - 1) // 2 for i in range(50)}


def test_attention_and_its_parts_agree(spark):
    rows = tokens(40)
    t = spark.createDataFrame(rows, TOK).withColumn("page_id", F.floor(F.col("pos") / 7).cast("long"))
    q = spark.createDataFrame([(i, h, rows[i][3]) for i in range(3) for h in range(2)], "query_id long, head int, q array<double>")
    flat = {(r["query_id"], r["head"]): (r["s"], r["o"]) for r in attention.attend(q, t, 4).collect()}
    for (i, h), (s, o) in flat.items():
        bs, bo = brute_attention(rows[i][3], [r for r in rows if r[2] == h])
        assert abs(s - bs) < 1e-9 and np.allclose(o, bo)
    parts = attention.states(attention.logits(q, t, 4), ["query_id", "head", "page_id"], 4)
    merged = {(r["query_id"], r["head"]): (r["s"], r["o"]) for r in attention.merge_states(parts, ["query_id", "head"], 4).collect()}
    assert all(abs(merged[k][0] - flat[k][0]) < 1e-9 and np.allclose(merged[k][1], flat[k][1]) for k in flat)


@pytest.mark.parametrize("block", [1, 5, 64])
def test_causal_blocks(spark, block):
    rows = tokens(23, seqs=2)
    got = attention.causal(spark.createDataFrame(rows, TOK), 4, block).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(x for x in rows if x[:3] == (r["seq_id"], r["pos"], r["head"]))
        s, o = brute_attention(own[3], [x for x in rows if x[0] == r["seq_id"] and x[2] == r["head"] and x[1] <= r["pos"]])
        assert abs(s - r["s"]) < 1e-9 and np.allclose(o, r["o"])


def test_merging_equal_states_and_extremes(spark):
    mk = lambda s, v: spark.createDataFrame([(0, 0, float(s), v)], "query_id long, head int, s double, o array<double>")
    r = attention.merge_two(mk(3, [0.0, 2.0]), mk(3, [4.0, 0.0]), ["query_id", "head"], 2).first()
    assert r["s"] == 4 and r["o"] == [2.0, 1.0]
    r = attention.merge_two(mk(10, [1.0, 1.0]), mk(-10, [9.0, 9.0]), ["query_id", "head"], 2).first()
    assert abs(r["o"][0] - (1 * 2**10 + 9 * 2**-10) / (2**10 + 2**-10)) < 1e-12
    r = attention.merge_two(mk(5, [1.0, 2.0]), mk(5, [0.0, 0.0]).limit(0), ["query_id", "head"], 2).first()
    assert r["s"] == 5 and r["o"] == [1.0, 2.0]


def test_bound_holds_and_digests_merge(spark):
    rows = tokens(60)
    t = spark.createDataFrame(rows, TOK).withColumn("page_id", F.floor(F.col("pos") / 8).cast("long"))
    d = scoring.digests(t, 4)
    q = spark.createDataFrame([(0, h, [1.0, -2.0, 0.5, 0.0]) for h in range(2)], "query_id long, head int, q array<double>")
    bound = {(r["page_id"], r["head"]): r["score"] for r in scoring.page_scores(q, d, 4).collect()}
    for s, p, h, k, v in rows:
        assert np.dot([1.0, -2.0, 0.5, 0.0], k) <= bound[p // 8, h] + 1e-12
    both = scoring.merge_digests(scoring.digests(t.where("pos < 21"), 4), scoring.digests(t.where("pos >= 21"), 4), 4)
    key = lambda df: sorted((r["page_id"], r["head"], r["hi"], r["lo"]) for r in df.collect())
    assert key(both) == key(d)


def test_store_within_budget_and_with_all_pages_is_exact(spark):
    rows = spark.createDataFrame(tokens(50, seqs=2), TOK)
    q = spark.createDataFrame([(i, i % 2, h, [0.3, -1.0, 0.7, 0.1]) for i in range(2) for h in range(2)], "query_id long, seq_id long, head int, q array<double>")
    key = lambda df: {(r["query_id"], r["head"]): (r["s"], r["o"]) for r in df.collect()}
    full = key(PagedStore(EngineConfig(n_heads=2, head_dim=4, page_size=8), rows).query(q).attend())
    for c in (EngineConfig(n_heads=2, head_dim=4, page_size=8), EngineConfig(n_heads=2, head_dim=4, page_size=8, budget=20), EngineConfig(n_heads=2, head_dim=4, page_size=4, budget=12, topk=7)):
        s = PagedStore(c, rows)
        got = key(s.query(q).select(k=None if c.page_size == 8 else 50).attend())
        assert all(abs(got[k][0] - full[k][0]) < 1e-9 and np.allclose(got[k][1], full[k][1]) for k in full)
    few = PagedStore(EngineConfig(n_heads=2, head_dim=4, page_size=4, budget=8, topk=2), rows).query(q).select()
    assert few.chosen.groupBy("query_id", "head").count().where("count <> 6").count() == 0
    new = rows.where("pos < 3").withColumnRenamed("pos", "ord")
    assert PagedStore(EngineConfig(n_heads=2, head_dim=4), rows).append(new).meta().where("n_rows = 53").count() == 2


def test_config_is_checked():
    with pytest.raises(ValueError):
        EngineConfig(n_win=1)
    with pytest.raises(ValueError):
        EngineConfig(budget=8, topk=6)
    assert EngineConfig(budget=16).pages_wanted == 8 and EngineConfig(budget=16, topk=0).pages_wanted == 0
    assert EngineConfig(budget=-1).budget is None


def test_positions_are_rotated(spark):
    x, pos = [1.0, 2.0, 3.0, 4.0], 5
    df = spark.createDataFrame([(x, pos)], "x array<double>, pos long")
    got = df.select(vectors.rope(F.col("x"), F.col("pos"), 4).alias("r")).first()["r"]
    a = [pos * 1e4 ** (-2 * i / 4) for i in range(2)]
    want = [x[i] * math.cos(a[i]) - x[i + 2] * math.sin(a[i]) for i in range(2)] + [x[i + 2] * math.cos(a[i]) + x[i] * math.sin(a[i]) for i in range(2)]
    assert np.allclose(got, want) and np.isclose(np.linalg.norm(got), np.linalg.norm(x))
    assert [round(one(spark, vectors.alibi_slope(F.lit(h), 6)), 6) for h in range(6)] == [0.25, 0.0625, 0.015625, 0.003906, 0.5, 0.125]


@pytest.mark.parametrize("dim", [1, 3, 37])
def test_norms(spark, dim):
    x = np.random.default_rng(dim).normal(size=dim)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    w = [1 + i / 7 for i in range(dim)]
    r = df.select(vectors.rms_norm(F.col("x"), w).alias("a"), vectors.l2_normalize(F.col("x"), dim).alias("b")).first()
    assert np.allclose(r["a"], x / np.sqrt((x**2).mean() + 1e-5) * w) and np.allclose(r["b"], x / np.linalg.norm(x))


def test_draws_at_the_ends(spark):
    p = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.0), (1, 0, 0.2), (1, 1, 0.3), (1, 2, 0.5)], "row_id long, token_id int, p double")
    d = spark.createDataFrame([(0, 0.0), (0, 0.999999), (1, 0.0), (1, 0.2), (1, 0.5), (1, 1.0)], "row_id long, u double")
    got = {(r["row_id"], r["u"]): r["token_id"] for r in sampling.inverse_cdf(p, d).collect()}
    assert got == {(0, 0.0): 1, (0, 0.999999): 1, (1, 0.0): 0, (1, 0.2): 1, (1, 0.5): 2, (1, 1.0): 2}


@pytest.mark.parametrize("k", [1, 3])
def test_rejection_draws_only_what_it_may(spark, k):
    rng = np.random.default_rng(k)
    p = np.concatenate([np.full(k, 0.8 / k), np.full(40, 0.2 / 40)])
    probs = spark.createDataFrame([(r, i, float(x)) for r in range(60) for i, x in enumerate(p)], "row_id long, token_id int, p double")
    draws = spark.createDataFrame([(r, n, float(rng.random())) for r in range(60) for n in range(32)], "row_id long, round int, u double")
    for got in (sampling.top_k(probs, draws, k).collect(), sampling.top_p(probs, draws, 0.8 * (1 - 0.5 / k)).collect()):
        assert len(got) == 60 and all(r["success"] for r in got)
        assert set(Counter(r["token_id"] for r in got)) <= set(range(k))


def test_stream_state_is_the_batch_result(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("seq_id"), "ts", "event_id")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = {}

    def keep(df, _):
        seen.update({r["seq_id"]: r for r in df.collect()})

    q = resident_pages(stream, 4, 8, n_win=3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    meta = paging.seq_meta(events, "seq_id", 4)
    for r in meta.collect():
        assert (seen[r["seq_id"]]["n_rows"], seen[r["seq_id"]]["n_pages"], seen[r["seq_id"]]["last_page_len"]) == (r["n_rows"], r["n_pages"], r["last_page_len"])
    slots = {}
    for r in paging.resident_slots(meta, 8, 3).orderBy("seq_id", "slot").collect():
        slots.setdefault(r["seq_id"], []).append(r["page_id"])
    assert {k: list(v["slots"]) for k, v in seen.items()} == slots


def test_wide_windows_shrink_before_they_turn():
    slots, win, ev = list(range(16)), 10, 0
    seen = []
    for page in range(16, 30):
        win, ev = grow(slots, win, ev, page, 16, 2, 2, 2)
        seen.append(win)
    assert seen[:10] == [9, 8, 7, 6, 5, 4, 3, 2, 2, 2] and slots[-2:] == [28, 29]


def test_many_queries_meet_rows_in_blocks(spark, monkeypatch):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("head"), F.col("id").alias("pos"))
    q = spark.range(40).select(F.col("id").alias("query_id"), (F.col("id") % 3).alias("head"))
    pairs = lambda: sorted(tuple(r) for r in scoring.meet(q, rows, ["head"], "pos").select("query_id", "pos").collect())
    want = pairs()
    monkeypatch.setattr(scoring, "BROADCAST_QUERIES", 7)
    assert scoring.meet(q, rows, ["head"], "pos").columns.count("head") == 1 and pairs() == want
    assert want == sorted((a, b) for a in range(40) for b in range(300) if a % 3 == b % 3)


def test_prefix_sums_of_far_apart_keys(spark):
    keys = [0, 1, 5, 4095, 4096, 10**6, 10**9, 10**15, 10**15 + 1, -7]
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key long, x long")
    got = {r["key"]: r["before"] for r in paging.prefix_sum(df, "key", "x", "before").collect()}
    order = sorted(keys)
    value = {k: i + 1 for i, k in enumerate(keys)}
    assert got == {k: sum(value[j] for j in order[:i]) for i, k in enumerate(order)}
    assert paging.prefix_sum(df.limit(0), "key", "x", "before").count() == 0


def test_runs_at_the_edges_of_spans(spark):
    ids = [*range(4090, 8200), 9000, 9001, *range(12288, 12290), 16383, 16384, 20479]
    got = sorted(tuple(r) for r in paging.contiguous_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert got == [(4090, 4110), (9000, 2), (12288, 2), (16383, 2), (20479, 1)]
    assert paging.allocate_run(spark.createDataFrame([(i,) for i in ids], "id long"), 3) == 4090
    with pytest.raises(ValueError):
        paging.allocate_run(spark.createDataFrame([(i,) for i in (1, 3, 5)], "id long"), 2)


def test_pruned_search_is_exact_on_any_pages(spark, sf):
    """Recall of the pruned and of the indexed search against brute force, at ids divisible by 20: all of it."""
    from pagewise import queries

    found = {name: {(r["query_id"], r["head"], r["pos"]) for r in queries.queries()[name](spark, sf).collect()} for name in ("exact_topk_rows", "digest_pruned_topk", "indexed_topk")}
    assert found["exact_topk_rows"] == found["digest_pruned_topk"] == found["indexed_topk"]


def test_split_plan_without_pages(spark):
    grids = spark.createDataFrame([(1,), (5,)], "grid long")
    plan = paging.split_plan(spark.createDataFrame([], "n_pages long"), grids)
    assert sorted(tuple(r) for r in plan.collect()) == [(1, 1, 0), (5, 1, 0)]
    plan = paging.split_plan(spark.createDataFrame([(0,), (7,), (3,)], "n_pages long"), grids)
    assert sorted(tuple(r) for r in plan.collect()) == [(1, 7, 3), (5, 3, 5)]
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()
