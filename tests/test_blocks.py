"""Blocks of queries against blocks of rows: what a plan makes, and results against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise import queries
from pagewise.operators import attention, blocks, scoring, selection

#: Queries that meet all rows. On the smallest table these are 50,000 pairs (of 2,000 rows).
ALL_PAIRS = "alibi_attention cascade_attention decode_attention exact_topk_rows indexed_topk merge_states partial_states decode_attention_masked grouped_query_attention merge_two_states digest_pruned_topk".split()


def made(node):
    """The most rows that a node of the executed plan made, and so that were sorted or moved."""
    inside = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
    inner = [getattr(node, inside)()] if inside else []
    below = [node.children().apply(i) for i in range(node.children().size())]
    metric = node.metrics().get("numOutputRows")
    return max([metric.get().value() if metric.isDefined() else 0, *map(made, inner), *map(made, below)])


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_pairs_of_many_queries_do_not_leave_their_cell(spark, sf, monkeypatch, name):
    monkeypatch.setattr(scoring.are_few, "__defaults__", (7,))
    df = queries.queries()[name](spark, sf)
    df.collect()
    assert 1000 <= made(df._jdf.queryExecution().executedPlan()) <= 10_000


def moved(node):
    """The records that the exchanges of the executed plan wrote."""
    inside = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
    inner = [getattr(node, inside)()] if inside else []
    metric = node.metrics().get("shuffleRecordsWritten")
    return (metric.get().value() if metric.isDefined() else 0) + sum(map(moved, [*inner, *(node.children().apply(i) for i in range(node.children().size()))]))


#: Records that may move, of 2,000 rows and 400 queries, or half of these rows with grouped heads.
MOVED = {"decode_attention": 3500, "cascade_attention": 3500, "decode_attention_masked": 3500, "grouped_query_attention": 2100, "digest_pruned_topk": 9000}


@pytest.mark.parametrize("name", MOVED)
def test_a_key_that_fits_a_block_moves_once(spark, sf, monkeypatch, name):
    """Blocks are counted by key: other heads' rows and queries make no more copies."""
    monkeypatch.setattr(blocks, "BLOCK", 150)
    df = queries.queries()[name](spark, sf)
    df.collect()
    assert 1000 < moved(df._jdf.queryExecution().executedPlan()) <= MOVED[name]


def bytes_moved(node):
    """The bytes of the rows that the exchanges of the executed plan wrote, before these are compressed."""
    inside = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
    inner = [getattr(node, inside)()] if inside else []
    metric = node.metrics().get("dataSize")
    return (metric.get().value() if metric.isDefined() else 0) + sum(map(bytes_moved, [*inner, *(node.children().apply(i) for i in range(node.children().size()))]))


#: Records and bytes that may move, of 2,000 rows and 100 queries in blocks of 50, where rows pass through a cell.
PASSING = {"cascade_attention": (2700, 600_000), "decode_attention_masked": (2700, 600_000), "grouped_query_attention": (2700, 600_000)}


@pytest.mark.parametrize("name", PASSING)
def test_rows_that_pass_do_not_repeat_queries(spark, sf, monkeypatch, name):
    """Neither queries nor states are repeated for each block of rows, and vectors of floats move as floats."""
    monkeypatch.setattr(blocks, "BLOCK", 50)
    df = queries.queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert 1000 < moved(plan) <= PASSING[name][0] and bytes_moved(plan) <= PASSING[name][1]


#: Records that may move, of 2,000 rows and 100 queries, where rows stay: queries, and a state of each from each of a few parts of the rows.
STAYING = {"decode_attention_masked": 900, "grouped_query_attention": 900}


@pytest.mark.parametrize("name", STAYING)
def test_many_rows_do_not_move(spark, sf, monkeypatch, name):
    """Each part of the queries reads the rows; what is found is the same."""
    want = sorted(map(tuple, queries.queries()[name](spark, sf).collect()))
    monkeypatch.setattr(blocks, "MOVED", 0, raising=False)
    df = queries.queries()[name](spark, sf)
    got = sorted(map(tuple, df.collect()))
    assert 0 < moved(df._jdf.queryExecution().executedPlan()) <= STAYING[name]
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=0, atol=2e-6)


def vectors(n, dim=4, seed=0, step=None):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x if step is None else x[np.arange(n) // step * step]


def frames(spark, x, q, page=7):
    t = spark.createDataFrame([(i, 0, i // page, r.tolist(), r[::-1].tolist()) for i, r in enumerate(x)], "pos long, head int, page_id long, k array<double>, v array<double>")
    return spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(q)], "query_id long, head int, q array<double>"), t


@pytest.fixture
def small(monkeypatch):
    """Blocks are cut by the driver; tiles by workers, which do not see this."""
    for name, n in {"BLOCK": 50, "PART": 20, "TILE": 600, "TILE_ROWS": 30, "TILE_QUERIES": 17, "PIECE": 5}.items():
        monkeypatch.setattr(blocks, name, n)


def brute_states(x, q, of=None, slope=0.0):
    z = (q @ x.T / math.sqrt(x.shape[1]) + slope * (np.arange(len(x))[None] - np.arange(len(q))[:, None])) * math.log2(math.e)
    z = z if of is None else z[:, of]
    w = 2 ** (z - z.max(axis=1, keepdims=True))
    v = (x if of is None else x[of])[:, ::-1]
    return z.max(axis=1) + np.log2(w.sum(axis=1)), w @ v / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("slope", [0.0, 0.25])
def test_attention_over_several_blocks(spark, small, slope):
    x, q = vectors(230), vectors(120, seed=1)
    s, o = brute_states(x, q, slope=slope)
    df = attention.attend(*frames(spark, x, q), 4, slope=F.lit(slope))
    got = {r["query_id"]: r for r in df.collect()}
    assert len(got) == 120 and all(abs(got[i]["s"] - s[i]) < 1e-9 and np.allclose(got[i]["o"], o[i]) for i in got)


def test_pages_and_their_merged_states_over_several_blocks(spark, small):
    x, q = vectors(230), vectors(120, seed=1)
    queries_, t = frames(spark, x, q)
    t = t.withColumn("page_id", F.expr("CASE WHEN pos < 100 THEN 0 ELSE page_id END"))  # one that is longer than a tile
    pages = {(r["query_id"], r["page_id"]): r for r in attention.page_states(queries_, t, 4, wide=2).collect()}
    of = {p: [i for i in range(230) if (0 if i < 100 else i // 7) == p] for p in {k[1] for k in pages}}
    assert len(pages) == 120 * len(of) and sum(map(len, of.values())) == 230
    for p, own in of.items():
        s, o = brute_states(x, q, own)
        assert all(abs(pages[i, p]["s"] - s[i]) < 1e-9 and np.allclose(pages[i, p]["o"], o[i][:2]) for i in range(120))
    s, o = brute_states(x, q)
    got = {r["query_id"]: r for r in attention.merged_pages(queries_, t, 4).collect()}
    assert len(got) == 120 and all(abs(got[i]["s"] - s[i]) < 1e-9 and np.allclose(got[i]["o"], o[i]) for i in got)


def test_vectors_that_are_not_there(spark):
    """A null row has no weight, a null query null states; in a search both have null scores, which come last."""
    x, q = vectors(30), vectors(3, seed=1)
    queries_, t = frames(spark, x, q)
    queries_ = queries_.withColumn("q", F.expr("CASE WHEN query_id <> 1 THEN q END"))
    t = t.withColumns({c: F.expr(f"CASE WHEN pos < 27 THEN {c} END") for c in "kv"})
    s, o = brute_states(x[:27], q)
    for df in (attention.attend(queries_, t, 4), attention.merged_pages(queries_, t, 4), attention.merge_two(*(attention.attend(queries_, t, 4, keep=F.col("pos") % 2 == i) for i in (0, 1)), ["query_id", "head"], 4)):
        got = {r["query_id"]: r for r in df.collect()}
        assert got[1]["s"] is None and got[1]["o"] == [None] * 4
        assert all(abs(got[i]["s"] - s[i]) < 1e-9 and np.allclose(got[i]["o"], o[i]) for i in (0, 2))
    for df in (selection.top_rows(queries_, t, 4, 29), selection.pruned_top_rows(queries_, t, 4, 1, 29)):
        rows = {(r["query_id"], r["rank"]): (r["pos"], r["score"]) for r in df.collect()}
        assert [rows[1, i + 1] for i in range(29)] == [(i, None) for i in range(29)]
        assert [rows[0, i + 1][0] for i in range(29)] == [*np.argsort(-(x[:27] @ q[0])).tolist(), 27, 28]


def test_vectors_that_floats_hold_and_others(spark, small):
    """Doubles keep their digits; elements that are null, and vectors that are short, in either form."""
    x, q = vectors(230), vectors(120, seed=1)
    x[::2], q[::3] = x[::2].astype("f4"), q[::3].astype("f4")
    z = q @ x.T / 2 * math.log2(math.e)
    z[:, [4, 5]] = -np.inf
    z[[6, 7]] = -np.inf
    v = x[:, ::-1].copy()
    v[[8, 9], 1] = v[11, 3] = 0
    queries_, t = frames(spark, x, q)
    queries_ = queries_.withColumn("q", F.expr("CASE WHEN query_id = 6 THEN transform(q, (e, i) -> if(i = 2, null, e)) WHEN query_id = 7 THEN slice(q, 1, 3) || array(double('NaN')) ELSE q END"))
    t = t.withColumn("k", F.expr("CASE WHEN pos IN (4, 5) THEN transform(k, (e, i) -> if(i = 1, null, e)) ELSE k END"))
    t = t.withColumn("v", F.expr("CASE WHEN pos IN (8, 9) THEN transform(v, (e, i) -> if(i = 1, null, e)) WHEN pos = 11 THEN transform(v, (e, i) -> if(i = 3, null, e)) ELSE v END"))
    got = {r["query_id"]: r for r in attention.attend(queries_, t, 4).collect()}
    assert len(got) == 120 and got[6]["s"] is None and got[7]["s"] is None
    w = np.exp2(z)
    for i in set(range(120)) - {6, 7}:
        assert abs(got[i]["s"] - np.log2(w[i].sum())) < 1e-9 and np.allclose(got[i]["o"], w[i] @ v / w[i].sum(), rtol=0, atol=1e-12)


@pytest.mark.parametrize("slope", [0.0, 0.25])
def test_attention_where_rows_stay(spark, small, monkeypatch, slope):
    """Two keys, one of them null; several parts of queries and of rows, and vectors that are null or short of an element."""
    for name, n in {"MOVED": 0, "CHUNK": 20, "PART": 30}.items():
        monkeypatch.setattr(blocks, name, n)
    x, q = vectors(230), vectors(120, seed=1)
    queries_, t = frames(spark, x, q)
    queries_ = queries_.withColumn("key", F.expr("CASE WHEN query_id % 2 = 0 THEN 'a' END")).withColumn("q", F.expr("CASE WHEN query_id <> 4 THEN q END"))
    t = t.withColumn("key", F.expr("CASE WHEN pos % 2 = 0 THEN 'a' END")).repartition(5)
    t = t.withColumn("k", F.expr("CASE WHEN pos IN (8, 9) THEN transform(k, (e, i) -> if(i = 1, null, e)) WHEN pos NOT IN (10, 11) THEN k END"))
    t = t.withColumn("v", F.expr("CASE WHEN pos = 12 THEN transform(v, (e, i) -> if(i = 3, null, e)) WHEN pos NOT IN (10, 11) THEN v END"))
    got = {r["query_id"]: r for r in attention.attend(queries_, t, 4, slope=F.lit(slope), on=("key",)).collect()}
    assert len(got) == 120 and got[4]["s"] is None and got[4]["o"] == [None] * 4
    z = (q @ x.T / 2 + slope * (np.arange(230)[None] - np.arange(120)[:, None])) * math.log2(math.e)
    z[:, 8:12] = -np.inf
    z[(np.arange(120)[:, None] - np.arange(230)[None]) % 2 == 1] = -np.inf
    v = x[:, ::-1].copy()
    v[12, 3] = 0
    for i in set(range(120)) - {4}:
        w = np.exp2(z[i] - z[i].max())
        assert abs(got[i]["s"] - z[i].max() - np.log2(w.sum())) < 1e-9 and np.allclose(got[i]["o"], w @ v / w.sum(), rtol=0, atol=1e-12)


@pytest.mark.parametrize("shape", ["copies", "clusters", "random"])
def test_searches_over_several_blocks(spark, small, shape):
    """Copies are told apart by position; clusters are where pages are passed over."""
    x, q = vectors(230, step=23 if shape == "copies" else None), vectors(120, seed=1)
    if shape == "clusters":
        x = x * 0.01 + np.repeat(vectors(46, seed=2) * 10, 5, axis=0)
    score = np.round(q @ x.T, 6)
    want = {(i, n + 1): int(p) for i in range(120) for n, p in enumerate(np.lexsort((np.arange(230), -score[i]))[:5])}
    queries_, t = frames(spark, x, q, page=5)
    long = t.withColumn("page_id", F.expr("CASE WHEN pos < 100 THEN 0 ELSE page_id END"))
    for df in (selection.top_rows(queries_, t, 4, 5), selection.pruned_top_rows(queries_, t, 4, 2, 5), selection.pruned_top_rows(queries_, long, 4, 2, 5)):
        assert {(r["query_id"], r["rank"]): r["pos"] for r in df.collect()} == want


@pytest.mark.parametrize("page", [1, 7, 100])
@pytest.mark.parametrize("k", [1, 5, 300])
def test_tiles(small, page, k):
    """One cell by itself, in tiles of a few rows and queries."""
    x, q = vectors(230), vectors(60, seed=1)
    own = blocks.Queries(np.arange(60), np.zeros(60, np.int32), np.zeros(60), q)
    rows = blocks.Rows(np.arange(230), np.arange(230) // page, x, x[:, ::-1])
    s, o = brute_states(x, q)
    for paged in (False, True):
        (b,) = blocks.softmax(own, rows, paged, True)
        assert np.allclose(b["s"], s) and np.allclose(b["o"].to_pylist(), o)
    parts = {(r["query_id"], r["page_id"]): r for b in blocks.softmax(own, rows, True, False) for r in b.to_pylist()}
    assert len(parts) == 60 * -(-230 // page)
    for p in range(-(-230 // page)):
        s, o = brute_states(x, q, list(range(p * page, min(230, p * page + page))))
        assert all(abs(parts[i, p]["s"] - s[i]) < 1e-9 and np.allclose(parts[i, p]["o"], o[i]) for i in range(60))
    score = np.round(q @ x.T, 6)
    want = {(i, int(p)) for i in range(60) for p in np.lexsort((np.arange(230), -score[i]))[:k]}
    for found in (blocks.nearest(own, rows, k), blocks.pruned(own, rows, k, 2)):
        assert {(r["query_id"], r["pos"]) for b in found for r in b.to_pylist()} == want
