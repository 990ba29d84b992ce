"""Drawing tokens from probability rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inverse_cdf(probs: DataFrame, draws: DataFrame, row: str = "row_id", token: str = "token_id") -> DataFrame:
    """Of each draw (``row``, ``u``) the least token whose cumulative probability passes u; the last if none does.

    Many draws may share a row. Sums and comparison stay in the engine.
    """
    w = Window.partitionBy(row).orderBy(token).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = probs.withColumn("cdf", F.sum("p").over(w))
    met = cdf.join(draws, row)
    keys = [c for c in draws.columns]
    picked = met.groupBy(*keys).agg(F.min(F.when(F.col("cdf") > F.col("u"), F.col(token))).alias("hit"), F.max(token).alias("last"))
    return picked.select(*keys, F.coalesce("hit", "last").alias(token))


def _rounds(p: np.ndarray, us: np.ndarray, accept) -> tuple[int, bool]:
    """Rejection rounds: draw among what lies over the pivot; accept, or let the drawn probability be the pivot."""
    pivot, q, chosen = 0.0, 1.0, len(p) - 1
    for u in us:
        over = np.where(p > pivot, p, 0.0)
        past = np.flatnonzero(np.cumsum(over) > u * q)
        chosen = int(past[0]) if len(past) else len(p) - 1
        pivot = max(pivot, float(p[chosen]))
        q = float(p[p > pivot].sum())
        if accept(p, pivot, q):
            return chosen, True
        if q <= 0:
            break
    return chosen, False


def _rejection(probs: DataFrame, draws: DataFrame, accept, each: DataFrame | None = None) -> DataFrame:
    """``row_id``, ``token_id``, ``success``; rows of a table of draws ``row_id``, ``round``, ``u``.

    ``each``: ``row_id`` and a value of the row's own, which ``accept`` is made from.
    """
    p = probs.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("token_id", "p"))).alias("ps"))
    u = draws.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("round", "u"))).alias("us"))
    own = each is not None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                ids = [x["token_id"] for x in r.ps]
                told = accept(r.own) if own else accept
                i, ok = _rounds(np.array([x["p"] for x in r.ps]), np.array([x["u"] for x in r.us]), told)
                out.append((r.row_id, ids[i], ok))
            yield pd.DataFrame(out, columns=["row_id", "token_id", "success"])

    met = p.join(u, "row_id")
    met = met.join(each.toDF("row_id", "own"), "row_id") if own else met
    return met.mapInPandas(work, "row_id long, token_id long, success boolean")


def top_k(probs: DataFrame, draws: DataFrame, k: int) -> DataFrame:
    """Samples among the k likeliest: accepted where fewer than k lie over the pivot."""
    return _rejection(probs, draws, lambda p, pivot, q: int((p > pivot).sum()) < k)


def top_p(probs: DataFrame, draws: DataFrame, mass: float | DataFrame) -> DataFrame:
    """Samples of the nucleus: accepted where what lies over the pivot weighs less than
    ``mass``, one number or a table ``row_id``, ``mass`` with one for each row."""
    within = lambda m: lambda p, pivot, q: 1 - q + m > 1 + 1e-5
    return _rejection(probs, draws, within, mass) if isinstance(mass, DataFrame) else _rejection(probs, draws, within(mass))


def argmax(scores: DataFrame, by: str, token: str = "token_id") -> DataFrame:
    """The greedy choice; ties: the lowest token."""
    return scores.groupBy(by).agg(F.max_by(token, F.struct("p", -F.col(token))).alias(token))
