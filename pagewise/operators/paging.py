"""Pages, slots, page tables and the arithmetic of budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scoring import few

#: Rows that one window of a prefix sum holds.
SPAN = 4096


def int_div(a: Column, b: int | Column) -> Column:
    """Whole-number division, exact for all longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def page_of(pos: Column, page_size: int) -> Column:
    return int_div(pos, page_size)


def slot_of(pos: Column, page_size: int) -> Column:
    return F.pmod(pos, F.lit(page_size)).cast("long")


def pages_for(rows: Column, page_size: int) -> Column:
    return int_div(rows + (page_size - 1), page_size)


def last_page_len(rows: Column, page_size: int) -> Column:
    """Rows on the last page; 0 of an empty sequence."""
    return F.when(rows > 0, F.pmod(rows - 1, F.lit(page_size)) + 1).otherwise(0).cast("long")


def split_heads(vectors: DataFrame, n_heads: int, head_dim: int, vec: str = "embedding") -> DataFrame:
    """One row per head: its slice of the vector as ``k`` and of the reversed vector as ``v``."""
    flat = F.col(vec).cast("array<double>")
    part = lambda x, h: F.slice(x, h * head_dim + 1, head_dim)
    per_head = F.array(*(F.struct(part(flat, h).alias("k"), part(F.reverse(flat), h).alias("v")) for h in range(n_heads)))
    rest = [c for c in vectors.columns if c != vec]
    return vectors.select(*rest, F.posexplode(per_head).alias("head", "kv")).select(*rest, "head", "kv.k", "kv.v")


def kv_head(q_head: Column, n_q_heads: int, n_kv_heads: int) -> Column:
    if n_q_heads % n_kv_heads:
        raise ValueError("query heads must be a multiple of key heads")
    return int_div(q_head, n_q_heads // n_kv_heads).cast("int")


def positions(rows: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the sequence from 0."""
    w = Window.partitionBy(seq).orderBy(*order)
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def seq_meta(rows: DataFrame, seq: str, page_size: int) -> DataFrame:
    n = rows.groupBy(F.col(seq).cast("long").alias("seq_id")).agg(F.count("*").alias("n_rows"))
    return n.select("seq_id", "n_rows", pages_for(F.col("n_rows"), page_size).alias("n_pages"), last_page_len(F.col("n_rows"), page_size).alias("last_page_len"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over rows before this one by integer ``key``.

    Sums run within spans of the key, then over spans within spans of these, and
    so on; the key's range gives the number of levels. So no task orders more
    than SPAN keys at a time, whether keys are dense or far apart.
    """
    ends = df.agg(F.min(key), F.max(key)).first()
    levels, width = 0, 0 if ends[0] is None else ends[1] // SPAN - ends[0] // SPAN
    while width >= SPAN:
        levels, width = levels + 1, width // SPAN
    return _prefix(df, key, value, out, levels).withColumn(out, F.col(out).cast("long"))


def _prefix(df: DataFrame, key: str, value: str, out: str, levels: int) -> DataFrame:
    span, total, of, before = (f"__{x}{levels}" for x in ("span", "total", "of", "before"))
    inner = Window.partitionBy(span).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    spans = df.withColumn(span, int_div(F.col(key), SPAN))
    totals = spans.groupBy(F.col(span).alias(of)).agg(F.sum(value).alias(total))
    if levels:
        totals = _prefix(totals, of, total, before, levels - 1)
    else:  # SPAN spans at most
        outer = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn(before, F.coalesce(F.sum(total).over(outer), F.lit(0)))
    local = spans.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    met = local.join(totals.select(of, before), F.col(span) == F.col(of))
    return met.withColumn(out, F.col(out) + F.col(before)).drop(span, of, before)


def indptr(meta: DataFrame) -> DataFrame:
    """Row offsets of each sequence in the ragged layout."""
    got = prefix_sum(meta, "seq_id", "n_rows", "indptr_start")
    return got.select("seq_id", "indptr_start", (F.col("indptr_start") + F.col("n_rows")).alias("indptr_end"))


def page_table(meta: DataFrame) -> DataFrame:
    """``seq_id``, ``page_ord``, ``pool_page_id``: pages numbered in the pool by sequence, then place."""
    first = prefix_sum(meta, "seq_id", "n_pages", "__first").where("n_pages > 0")
    rows = first.select("seq_id", "__first", F.posexplode(F.expr("sequence(0L, n_pages - 1)")).alias("i", "page_ord"))
    return rows.select("seq_id", "page_ord", (F.col("__first") + F.col("page_ord")).alias("pool_page_id"))


def pooled(rows: DataFrame, table: DataFrame, page_size: int) -> DataFrame:
    """Rows with ``seq_id`` and ``pos`` as they lie in the pool: ``pool_page_id``, ``slot`` and the rest."""
    placed = rows.withColumn("page_ord", page_of(F.col("pos"), page_size)).withColumn("slot", slot_of(F.col("pos"), page_size))
    return placed.join(table, ["seq_id", "page_ord"]).drop("pos")


def paged_to_ragged(pool: DataFrame, table: DataFrame, meta: DataFrame, page_size: int) -> DataFrame:
    """Pool rows by way of the page table, less what lies beyond a last page's length, with ``pos``."""
    of = table.join(meta.select("seq_id", "n_pages", "last_page_len"), "seq_id")
    met = pool.drop("seq_id", "page_ord").join(of, "pool_page_id")
    kept = met.where((F.col("page_ord") < F.col("n_pages") - 1) | (F.col("slot") < F.col("last_page_len")))
    return kept.withColumn("pos", F.col("page_ord") * page_size + F.col("slot")).drop("pool_page_id", "page_ord", "slot", "n_pages", "last_page_len")


def append(meta: DataFrame, new: DataFrame, page_size: int) -> DataFrame:
    """Positions, pages and slots of ``new`` rows (``seq_id``, ``ord``) behind the rows there are."""
    w = Window.partitionBy("seq_id").orderBy("ord")
    at = new.join(meta.select("seq_id", "n_rows"), "seq_id", "left")
    at = at.withColumn("pos", F.coalesce("n_rows", F.lit(0)) + F.row_number().over(w) - 1).drop("n_rows")
    return at.withColumn("page_ord", page_of(F.col("pos"), page_size)).withColumn("slot", slot_of(F.col("pos"), page_size))


def bytes_to_pages(octets: Column, page_size: int, n_heads: int, head_dim: int, item: int) -> Column:
    return int_div(octets, 2 * page_size * n_heads * head_dim * item)


def layer_policy(spark: SparkSession, n_layers: int, budget: int | None, topk: int | None, n_unlimited: int) -> DataFrame:
    """``layer``, ``budget``, ``topk``; the first layers unlimited (null), an unset top-k half the budget."""
    limited = F.when(F.col("id") >= n_unlimited, F.lit(budget).cast("int"))
    k = F.when(limited.isNotNull(), F.coalesce(F.lit(topk).cast("int"), int_div(limited, 2).cast("int")))
    return spark.range(n_layers).select(F.col("id").cast("int").alias("layer"), limited.alias("budget"), k.alias("topk"))


def anchor_layer(layer: Column, n_reuse: Column) -> Column:
    """The layer whose selection a layer reuses; 0: its own."""
    offset = F.pmod(layer - 2, n_reuse)
    return F.when((n_reuse == 0) | (layer <= 2) | (offset == 0), F.lit(0)).otherwise(layer - offset)


def eligible(pages: DataFrame, policy: DataFrame) -> DataFrame:
    """Layers that select pages: those with a budget that ``n_pages`` exceeds."""
    return pages.join(few(policy), "layer").where("budget IS NOT NULL AND n_pages > budget")


def budget_split(n: Column, budget: int, n_sink: int, n_win: int, ratio: int) -> dict[str, Column]:
    """At the end of a bulk load: pages to offload, those of them that stay indexed in
    place of resident ones, and the window that is left; nothing within the budget."""
    over = n - budget
    off = F.least(over * ratio, n - n_sink - n_win)
    indexed = F.least(off - over, F.lit(budget - n_sink - n_win))
    more = over > 0
    return {
        "n_off": F.when(more, off).otherwise(0).cast("long"),
        "n_indexed": F.when(more, indexed).otherwise(0).cast("long"),
        "n_win": F.when(more, budget - indexed - n_sink).otherwise(n_win).cast("long"),
    }


def window_after(step: Column, n_win0: Column, n_win: int, ratio: int) -> Column:
    """Window pages after so many further pages: ratio - 1 fewer each, down to the final count."""
    return F.greatest(F.lit(n_win), n_win0 - step * (ratio - 1))


def pages_evicted(n_win_now: Column, n_win: int, ratio: int) -> Column:
    """Window pages that the next page pushes out to the index."""
    shrink = F.when(n_win_now - ratio + 1 >= n_win, F.lit(ratio)).otherwise(n_win_now - n_win + 1)
    return F.when(n_win_now == n_win, F.lit(1)).otherwise(shrink)


def round_robin_slot(budget: int, n_win: Column, count: Column, n_sink: int) -> Column:
    """The slot that the next page's predecessor overwrites."""
    usual = budget - n_win + F.pmod(count, F.greatest(n_win - 1, F.lit(1)))
    return F.when(n_win > 1, usual).otherwise(n_sink + F.pmod(count, F.lit(max(1, budget - n_sink - 1))))


def offload_due(n_pages: Column, last_len: Column, budget: int, page_size: int) -> Column:
    return (n_pages >= budget) & (last_len == page_size)


def resident_slots(meta: DataFrame, budget: int, n_win: int) -> DataFrame:
    """``seq_id``, ``slot``, ``page_id`` after growing page by page: up to the budget in
    order, then the last page moves to the round-robin slot and the new one takes its place."""
    slots = meta.where("n_pages > 0").select("seq_id", "n_pages", F.explode(F.expr(f"sequence(0L, least(n_pages, {budget}L) - 1)")).alias("slot"))
    evicted, j = F.col("n_pages") - budget, F.col("slot") - (budget - n_win)
    turns = n_win - 1
    last = evicted - 1 - F.pmod(evicted - 1 - j, F.lit(turns))  # latest eviction that used this slot
    moved = (evicted > 0) & (j >= 0) & (j < turns) & (last >= 0)
    page = F.when((evicted > 0) & (F.col("slot") == budget - 1), F.col("n_pages") - 1).when(moved, budget - 1 + last).otherwise(F.col("slot"))
    return slots.select("seq_id", "slot", page.cast("long").alias("page_id"))


def free_ids(spark: SparkSession, capacity: int, used: DataFrame, id_col: str) -> DataFrame:
    return spark.range(capacity).join(used.select(F.col(id_col).alias("id")), "id", "left_anti")


def contiguous_runs(ids: DataFrame, id_col: str = "id", least: int = 1) -> DataFrame:
    """``start_id``, ``n`` of each maximal run of consecutive ids of ``least`` or more.

    A run starts at an id whose predecessor is not there. Ids are dealt to spans
    and cut there. Pieces within a span are runs; only those that touch a span's
    edge, two a span at most, are joined by a second pass.
    """
    i = ids.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("span", int_div(F.col("id"), SPAN))
    local = i.withColumn("isle", F.col("id") - F.row_number().over(Window.partitionBy("span").orderBy("id")))
    pieces = local.groupBy("span", "isle").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    edge = (F.pmod("a", F.lit(SPAN)) == 0) | (F.pmod("b", F.lit(SPAN)) == SPAN - 1)
    order = Window.orderBy("a")
    begins = F.when(F.col("a") == F.lag("b").over(order) + 1, 0).otherwise(1)
    runs = pieces.where(edge).select("a", "b", begins.alias("new")).select("a", "b", F.sum("new").over(order).alias("run"))
    joined = runs.groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("a", "b")
    whole = pieces.where(~edge).select("a", "b").unionByName(joined)
    return whole.select(F.col("a").alias("start_id"), (F.col("b") - F.col("a") + 1).alias("n")).where(F.col("n") >= least)


def allocate_run(ids: DataFrame, n: int, id_col: str = "id") -> int:
    """The first id of the first ``n`` consecutive free ids; without such a run an error."""
    first = contiguous_runs(ids, id_col, n).agg(F.min("start_id")).first()[0]
    if first is None:
        raise ValueError(f"no {n} consecutive pages are free")
    return first


def split_plan(pages: DataFrame, grids: DataFrame, n_heads: int = 1) -> DataFrame:
    """For each ``grid``: the fewest pages a chunk may have so that chunks times heads are at most ``grid``.

    ``pages``: ``n_pages`` per sequence, of which only the different lengths and
    their counts are looked at, as one array: each grid's size is found in it by
    bisection. If even whole sequences are too many, the longest is a chunk; an
    empty sequence counts as one chunk in the end.
    """
    counts = pages.groupBy("n_pages").agg(F.count("*").alias("c"))
    held = counts.agg(F.collect_list(F.struct("n_pages", "c")).alias("cs")).scalar()
    long = lambda x: F.lit(x).cast("long")
    rows = grids.select("grid", held.alias("cs"))
    chunks = lambda size, least: F.aggregate("cs", long(0), lambda t, x: t + int_div(F.greatest(x["n_pages"], long(least)) + size - 1, size) * x["c"])
    longest = F.greatest(F.aggregate("cs", long(1), lambda t, x: F.greatest(t, x["n_pages"])), long(1))

    def halve(s: Column, _: Column) -> Column:
        middle = int_div(s["lo"] + s["hi"], 2)
        fits = chunks(middle, 0) * n_heads <= F.col("grid")
        return F.when(s["lo"] >= s["hi"], s).when(fits, F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))

    # lo..hi holds the answer; the longest is its end whether or not it fits.
    start = F.struct(long(1).alias("lo"), longest.alias("hi"))
    rows = rows.withColumn("size", F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, halve)["lo"])
    return rows.select("grid", F.col("size").alias("pages_per_chunk"), chunks(F.col("size"), 1).alias("n_chunks"))
