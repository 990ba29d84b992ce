"""Page digests and the scores of pages for queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import array_of, cuboid_bound, dot

#: Query rows that are sent to every task; more are dealt in blocks of this size.
BROADCAST_QUERIES = 10_000
#: Parts that rows are dealt into where queries are not broadcast.
ROW_PARTS = 64


def are_few(rows: DataFrame, most: int = BROADCAST_QUERIES) -> bool:
    """Whether there are at most so many rows; no more are read than that takes."""
    return rows.limit(most + 1).count() <= most


def few(rows: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """The rows, marked for broadcast where a bounded count shows that they are few."""
    return F.broadcast(rows) if are_few(rows, most) else rows


def meet(queries: DataFrame, rows: DataFrame, on: list[str], spread: str) -> DataFrame:
    """All pairs of queries and rows that agree ``on``.

    Few queries are broadcast. More are dealt in blocks by their id, and rows in
    parts by ``spread``: a task joins one block with one part, so a head that
    all rows share is dealt over parts times blocks of tasks.
    """
    if are_few(queries):
        return rows.join(F.broadcast(queries), on)
    blocks = queries.count() // BROADCAST_QUERIES + 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("__part", numbers(ROW_PARTS))
    r = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(ROW_PARTS))).withColumn("__block", numbers(blocks))
    return r.join(q, [*on, "__block", "__part"]).drop("__block", "__part")


def digests(tokens: DataFrame, dim: int, by: tuple[str, ...] = ("page_id", "head")) -> DataFrame:
    """Per-dimension greatest (``hi``) and least (``lo``) key elements of each page and head.

    One row per group with fixed-width partial maxima, so sums combine before the shuffle.
    """
    return _extremes(tokens, dim, by, "k", "k")


def _extremes(rows: DataFrame, dim: int, by: tuple[str, ...], hi: str, lo: str) -> DataFrame:
    g = rows.groupBy(*by).agg(*(F.expr(f"max({hi}[{i}]) AS h{i}") for i in range(dim)), *(F.expr(f"min({lo}[{i}]) AS l{i}") for i in range(dim)))
    return g.select(*by, array_of("h{i}", dim).alias("hi"), array_of("l{i}", dim).alias("lo"))


def merge_digests(old: DataFrame, new: DataFrame, dim: int, by: tuple[str, ...] = ("page_id", "head")) -> DataFrame:
    """Digests of pages after rows were added, from both parts' digests."""
    return _extremes(old.unionByName(new), dim, by, "hi", "lo")


def insert(index: DataFrame, new: DataFrame, dim: int, by: tuple[str, ...] = ("page_id", "head")) -> DataFrame:
    """An index of digests with ``new`` rows in it; pages that have such rows are ``changed``.

    Only new rows are read and only their pages' digests are merged.
    """
    added = digests(new, dim, by)
    touched = added.select(*by)
    merged = merge_digests(index.join(touched, list(by), "left_semi"), added, dim, by).withColumn("changed", F.lit(True))
    return index.join(touched, list(by), "left_anti").withColumn("changed", F.lit(False)).unionByName(merged)


def page_scores(queries: DataFrame, pages: DataFrame, dim: int) -> DataFrame:
    """``query_id``, ``page_id``, ``head``, ``score``: upper bounds of each page's dot products.

    Queries (``query_id``, ``head``, ``q``) meet digests on the head; see ``meet``.
    """
    q = queries.select("query_id", "head", "q")
    return meet(q, pages, ["head"], "page_id").select("query_id", "page_id", "head", cuboid_bound("q", "hi", "lo", dim).alias("score"))


def group_mean(scores: DataFrame, group: int) -> DataFrame:
    """Mean score over each group of heads."""
    return scores.groupBy("query_id", "page_id", F.floor(F.col("head") / group).cast("int").alias("grp")).agg(F.avg("score").alias("score"))


def head_sum(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "page_id").agg(F.sum("score").alias("score"))


def projection_pages(tokens: DataFrame, direction: list[float], page_size: int, by: str = "head") -> DataFrame:
    """Tokens clustered into pages by their keys' projection on one direction, per head.

    Rows are ordered by projection and cut into pages of ``page_size``; of
    equal projections the earlier position comes first. Order is found by
    ranges of the projection, so no task sorts a whole head unless it is small.
    """
    proj = tokens.withColumn("proj", dot(F.col("k"), F.array(*(F.lit(float(x)) for x in direction)), len(direction)))
    bucket = F.floor(F.col("proj") * 64).cast("long")
    b = proj.withColumn("__b", bucket)
    inner = Window.partitionBy(by, "__b").orderBy("proj", "pos")
    counts = b.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = b.withColumn("__r", F.row_number().over(inner) - 1).join(starts, [by, "__b"])
    return placed.withColumn("page_id", F.floor((F.col("__start") + F.col("__r")) / page_size).cast("long")).drop("__b", "__n", "__start", "__r")
