"""Softmax-weighted sums over rows, as partial states that merge in any order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import LOG2E, array_of, dot
from . import blocks
from .scoring import few, meet

#: Logit of no rows at all: the weighted sum is 0 then.
NOTHING = -5e4


def logits(queries: DataFrame, tokens: DataFrame, dim: int, bias: Column | None = None, keep: Column | None = None, on: tuple[str, ...] = ("head",)) -> DataFrame:
    """Query and row pairs on the same head with base-2 ``logit``; ``keep`` masks rows out."""
    met = meet(queries, tokens, list(on), "pos") if "query_id" in queries.columns else tokens.join(few(queries), list(on))
    met = met if keep is None else met.where(keep)
    score = dot("q", "k", dim) / math.sqrt(dim)
    return met.withColumn("logit", (score if bias is None else score + bias) * LOG2E)


def states(pairs: DataFrame, by: list[str], dim: int, few_groups: bool = False) -> DataFrame:
    """Partial state of each group: ``s``, log2 of the summed weights, and ``o``, the weighted mean.

    The greatest logit is found first and joined back; both passes are sums and
    maxima of fixed width that combine before the shuffle. With ``few_groups``,
    which the caller has counted, the maxima are broadcast and pairs never
    move; otherwise pairs are dealt by group once, and summed where they lie.
    """
    top = pairs.groupBy(*by).agg(F.max("logit").alias("__m"))
    top = F.broadcast(top) if few_groups else top
    w = F.pow(F.lit(2.0), F.col("logit") - F.col("__m"))
    met = pairs.join(top, by).withColumn("__w", w)
    sums = met.groupBy(*by).agg(F.first("__m").alias("__m"), F.sum("__w").alias("__d"), *(F.expr(f"sum(__w * v[{i}]) AS __o{i}") for i in range(dim)))
    return sums.select(*by, (F.col("__m") + F.log2("__d")).alias("s"), array_of("__o{i} / __d", dim).alias("o"))


def merge_states(parts: DataFrame, by: list[str], dim: int) -> DataFrame:
    """Any number of states of a group as one; they are made, and move, once."""
    top = F.max("s").over(Window.partitionBy(*by))
    met = parts.withColumn("__m", top).withColumn("__w", F.pow(F.lit(2.0), F.col("s") - F.col("__m")))
    sums = met.groupBy(*by).agg(F.first("__m").alias("__m"), F.sum("__w").alias("__d"), *(F.expr(f"sum(__w * o[{i}]) AS __o{i}") for i in range(dim)))
    return sums.select(*by, (F.col("__m") + F.log2("__d")).alias("s"), array_of("__o{i} / __d", dim).alias("o"))


def merge_two(a: DataFrame, b: DataFrame, by: list[str], dim: int) -> DataFrame:
    """States of two sides on the same keys; a key of one side only keeps that side's, and one whose states are null has null."""
    met = a.select(*by, F.col("s").alias("sa"), F.col("o").alias("oa")).join(b.select(*by, F.col("s").alias("sb"), F.col("o").alias("ob")), by, "full")
    m = F.greatest("sa", "sb")
    wa, wb = (F.coalesce(F.pow(F.lit(2.0), F.col(c) - m), F.lit(0.0)) for c in ("sa", "sb"))
    part = lambda c, i: F.coalesce(F.col(c)[i], F.lit(0.0))
    o = F.array(*((part("oa", i) * wa + part("ob", i) * wb) / F.nullif(wa + wb, F.lit(0.0)) for i in range(dim)))
    return met.select(*by, (m + F.log2(wa + wb)).alias("s"), o.alias("o"))


def with_empty(attended: DataFrame, queries: DataFrame, by: list[str], dim: int) -> DataFrame:
    """States for all queries; those that met no row have weight ``NOTHING`` and a sum of 0."""
    all_ = queries.select(*by).distinct().join(attended, by, "left")
    return all_.select(*by, F.coalesce("s", F.lit(NOTHING)).alias("s"), F.coalesce("o", F.array(*(F.lit(0.0) for _ in range(dim)))).alias("o"))


def attend(queries: DataFrame, tokens: DataFrame, dim: int, slope: Column | None = None, keep: Column | None = None, on: tuple[str, ...] = ("head",)) -> DataFrame:
    """``query_id``, ``head``, ``s``, ``o`` over all rows that the mask ``keep`` of rows leaves.

    ``slope``, of queries, is what a logit gains for each position that a row is behind the query. Pairs
    are made where rows pass a block of queries, and only a state of each part of the rows moves.
    """
    rows = (tokens if keep is None else tokens.where(keep)).select("pos", *on, "k", "v")
    return merge_states(blocks.passed(queries, rows, on, dim, dim, slope), ["query_id", "head"], dim)


def page_states(queries: DataFrame, tokens: DataFrame, dim: int, wide: int | None = None) -> DataFrame:
    """``query_id``, ``head``, ``page_id``, ``s``, ``o`` of each page, ``o`` for the first ``wide`` elements of ``v``; nothing moves after they are made."""
    work = lambda q, r: blocks.softmax(q, r, paged=True, merged=False)
    rows = tokens.select("pos", "head", "page_id", "k", "v")
    return blocks.cells(queries, rows, ("head",), dim, wide or dim, work, "query_id long, head int, page_id long, s double, o array<double>")


def merged_pages(queries: DataFrame, tokens: DataFrame, dim: int) -> DataFrame:
    """The states of pages merged: those of a cell where they are made, and then those of cells."""
    work = lambda q, r: blocks.softmax(q, r, paged=True, merged=True)
    rows = tokens.select("pos", "head", "page_id", "k", "v")
    parts = blocks.cells(queries, rows, ("head",), dim, dim, work, "query_id long, head int, s double, o array<double>")
    return merge_states(parts, ["query_id", "head"], dim)


def explode_o(attended: DataFrame, by: list[str], *more: Column) -> DataFrame:
    return attended.select(*by, F.posexplode("o").alias("dim", "o"), *more)


def causal(tokens: DataFrame, dim: int, block: int = 256) -> DataFrame:
    """``seq_id``, ``pos``, ``head``, ``s``, ``o``: every row over the rows up to itself.

    Rows of a head and sequence lie in blocks; a block of queries meets each
    block of keys not after it, as matrix products of two blocks at a time. The
    pairs are dealt by query block, so one long sequence is dealt over as many
    tasks as it has blocks. States of block pairs merge by sums.
    """
    t = tokens.select("seq_id", "pos", "head", "k", "v").withColumn("b", F.floor(F.col("pos") / block).cast("long"))
    cells = lambda name: F.array_sort(F.collect_list(F.struct("pos", "k", "v"))).alias(name)
    packed = t.groupBy("seq_id", "head", "b").agg(cells("rows"))
    q = packed.select("seq_id", "head", F.col("b").alias("qb"), F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["k"].alias("k"))).alias("qr"))
    last = few(tokens.groupBy("seq_id").agg(F.floor(F.max("pos") / block).cast("long").alias("last")))
    keys = packed.join(last, "seq_id").select("seq_id", "head", "rows", F.explode(F.sequence("b", "last")).alias("qb"))
    pairs = keys.join(q, ["seq_id", "head", "qb"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"seq_id": [], "pos": [], "head": [], "s": [], "o": []}
            for r in batch.to_pylist():
                qp, kp = (np.array([x["pos"] for x in r[n]]) for n in ("qr", "rows"))
                qm, km = (np.array([x["k"] for x in r[n]]) for n in ("qr", "rows"))
                vm = np.array([x["v"] for x in r["rows"]])
                z = qm @ km.T / math.sqrt(dim) * LOG2E
                z[kp[None, :] > qp[:, None]] = -np.inf
                m = z.max(axis=1, keepdims=True)
                w = np.exp2(z - m)
                d = w.sum(axis=1, keepdims=True)
                out["seq_id"] += [r["seq_id"]] * len(qp)
                out["head"] += [r["head"]] * len(qp)
                out["pos"] += qp.tolist()
                out["s"] += (m + np.log2(d))[:, 0].tolist()
                out["o"] += (w @ vm / d).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("seq_id", pa.int64()), ("pos", pa.int64()), ("head", pa.int32()), ("s", pa.float64()), ("o", pa.list_(pa.float64()))]))

    parts = pairs.mapInArrow(work, "seq_id long, pos long, head int, s double, o array<double>")
    return merge_states(parts, ["seq_id", "pos", "head"], dim)
