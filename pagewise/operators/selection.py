"""Which pages are taken, and how that meets what is resident."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .scoring import few


def top_pages(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "head"), least: bool = False) -> DataFrame:
    """The ``k`` pages of greatest (or least) score of each group with their ``rank`` from 1; ties: the lower page.

    The rank limit is applied before the shuffle too, so at most k rows of a
    group leave a task.
    """
    order = F.col("score").asc() if least else F.col("score").desc()
    w = Window.partitionBy(*by).orderBy(order, "page_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(pages: DataFrame, n_pages: Column, n_sink: int, n_win: int) -> DataFrame:
    """Pages that are scored: all but the first ``n_sink`` and the last ``n_win``."""
    return pages.where((F.col("page_id") >= n_sink) & (F.col("page_id") < n_pages - n_win))


def kind_of(page: Column, n_pages: Column, n_sink: int, n_win: int) -> Column:
    return F.when(page < n_sink, "sink").when(page >= n_pages - n_win, "window")


def with_kept_pages(chosen: DataFrame, queries: DataFrame, pages: DataFrame, n_sink: int, n_win: int) -> DataFrame:
    """``query_id``, ``page_id``, ``kind``: chosen pages, and the first and last ones for every query.

    ``pages`` has one row per page with ``n_pages``; only the kept ones meet the queries.
    """
    kind = kind_of(F.col("page_id"), F.col("n_pages"), n_sink, n_win)
    kept = pages.select("page_id", kind.alias("kind")).where("kind IS NOT NULL")
    always = queries.select("query_id").distinct().join(F.broadcast(kept))
    return chosen.select("query_id", "page_id", F.lit("topk").alias("kind")).unionByName(always)


def interleave_unique(ranked: DataFrame, group: int, k: int) -> DataFrame:
    """Lists of a head group merged rank by rank, the first ``k`` different pages of each.

    A page's place is its first in the order rank, then head within the group.
    """
    place = (F.col("rank") - 1) * group + F.pmod(F.col("head"), F.lit(group))
    first = ranked.groupBy("query_id", F.floor(F.col("head") / group).cast("int").alias("kv_head"), "page_id").agg(F.min(place).alias("place"))
    w = Window.partitionBy("query_id", "kv_head").orderBy("place")
    return first.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def first_unique(rows: DataFrame, value: str, order: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``k`` different values by order of appearance."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("ord"))
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy("ord")
    return first.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def recall_set(chosen: DataFrame, resident: DataFrame, changed: DataFrame | None, on: list[str]) -> DataFrame:
    """Chosen pages that are not resident, and resident ones that changed."""
    missing = chosen.join(resident, on, "left_anti")
    if changed is None:
        return missing
    return missing.unionByName(chosen.join(resident, on, "left_semi").join(changed, changed.columns, "left_semi"))


def evict_set(chosen: DataFrame, resident: DataFrame, on: list[str]) -> DataFrame:
    """Resident pages that are not chosen: their slots are free."""
    return resident.join(chosen, on, "left_anti")


def scatter(recalled: DataFrame, evicted: DataFrame, by: list[str]) -> DataFrame:
    """The i-th recalled page (by ``rank``) takes the i-th evicted page's place (by page), per group.

    ``transit_row`` numbers recalled pages over heads of a query: the pages of
    lower heads come first. Pages without a place are not moved.
    """
    r = recalled.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "page_id")))
    e = evicted.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("page_id"))).select(*by, "i", F.col("page_id").alias("slot_page"))
    counts = r.groupBy(*by).agg(F.count("*").alias("n"))
    before = Window.partitionBy(by[0]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    met = r.join(offsets, by).join(e, [*by, "i"])
    return met.select(*by, "page_id", "slot_page", (F.col("offset") + F.col("i") - 1).cast("long").alias("transit_row"))


def reconcile(scores: DataFrame, resident: DataFrame, k: int) -> DataFrame:
    """One step of selection against residents: ``query_id``, ``page_id``, ``action``.

    Of the ``k`` best candidates residents are ``hit`` and keep their slots, the
    others are ``recall``; as many residents as are recalled, those of least
    score, are ``victim``. Scores and residents are of candidate pages only.
    """
    best = top_pages(scores, k, ("query_id",))
    r = resident.select("query_id", "page_id").withColumn("here", F.lit(True))
    chosen = best.join(r, ["query_id", "page_id"], "left").select("query_id", "page_id", F.when(F.col("here"), "hit").otherwise("recall").alias("action"))
    need = chosen.groupBy("query_id").agg(F.sum(F.when(F.col("action") == "recall", 1).otherwise(0)).alias("n"))
    scored = scores.join(r, ["query_id", "page_id"], "left_semi")
    low = top_pages(scored, k, ("query_id",), least=True).join(need, "query_id").where("rank <= n")
    return chosen.unionByName(low.select("query_id", "page_id", F.lit("victim").alias("action")))


def placement(pages: DataFrame, scores: DataFrame, n_pages: Column, k: int, n_sink: int, n_win: int) -> DataFrame:
    """After a bulk load, per page whether it is ``resident``: first, last and the ``k`` best others."""
    best = top_pages(scores, k, ("query_id",)).select("query_id", "page_id", F.lit(True).alias("best"))
    met = pages.join(best, ["query_id", "page_id"], "left")
    kept = kind_of(F.col("page_id"), n_pages, n_sink, n_win).isNotNull()
    return met.withColumn("resident", kept | F.coalesce("best", F.lit(False))).drop("best")


def reuse(selection: DataFrame, layers: DataFrame) -> DataFrame:
    """Each layer's selection, which is its anchor's (``layer``, ``anchor``; anchor 0: its own).

    With an ``offset`` beside it, the layer's pool numbers a page so much higher than its anchor's.
    """
    source = F.when(F.col("anchor") == 0, F.col("layer")).otherwise(F.col("anchor"))
    offset = F.col("offset") if "offset" in layers.columns else F.lit(0)
    of = layers.select("layer", source.alias("of"), offset.cast("long").alias("__offset"))
    met = selection.withColumnRenamed("layer", "of").join(few(of), "of")
    return met.withColumn("page_id", F.col("page_id") + F.col("__offset")).drop("of", "__offset")


def gather(recalled: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """The rows of recalled pages, from where they are kept; pages that are not there give none."""
    return pool.join(recalled, on)


def top_rows(queries: DataFrame, tokens: DataFrame, dim: int, k: int) -> DataFrame:
    """The ``k`` best rows of each query and head by dot product, with ``score`` and ``rank``; of scores equal at six digits the lower position comes first.

    Pairs are made in cells of a block of queries and one of rows; a cell's best rows move, and the best of these are taken.
    """
    return _best(queries, tokens.select("pos", "head", "k"), dim, k, lambda q, r: blocks.nearest(q, r, k))


def pruned_top_rows(queries: DataFrame, tokens: DataFrame, dim: int, n_pages: int, k: int) -> DataFrame:
    """The same, as exactly, from the pages (``page_id`` of ``tokens``) that may hold them; see ``blocks.pruned``.

    No row of a page exceeds its digest's bound. In each cell first the rows of the ``n_pages`` pages of
    greatest bound are scored, then those pages whose bound is not under the k-th score found.
    """
    return _best(queries, tokens.select("pos", "head", "page_id", "k"), dim, k, lambda q, r: blocks.pruned(q, r, k, n_pages))


def _best(queries: DataFrame, rows: DataFrame, dim: int, k: int, work: Callable) -> DataFrame:
    found = blocks.cells(queries, rows, ("head",), dim, 0, work, "query_id long, head int, pos long, score double")
    w = Window.partitionBy("query_id", "head").orderBy(F.round("score", 6).desc(), "pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
