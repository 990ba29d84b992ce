"""Mixing sources to target weights by nested hash-threshold histograms; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fits, small

#: Hex digits of the hash: 60 bits, a non-negative long.
DIGITS = 15
#: Bits that a histogram level resolves, so a source has 4096 buckets at a time; 5 levels reach single hash values.
LEVEL_BITS = 12
LEVELS = 5
#: Sources whose thresholds are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words of a text (null: 0). Blanks are the six that separate words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """A uniform 60-bit number from the key as text and the text (nulls: empty), the same in any engine with MD5.

    The text tells rows apart that share an id or have none.
    """
    empty = F.lit("")
    both = F.concat(F.coalesce(key.cast("string"), empty), F.lit("\n"), F.coalesce(text, empty))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` in ranges of ``order``, each with the number ``part`` of its range; rows that tie share one.

    Running sums then go by range and over the ranges' totals, so no task holds all rows.
    """
    return cut(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part")))


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """``rows`` with sums over all earlier ranges (0 for the first); of ranges there are as many as shuffle partitions."""
    totals = rows.groupBy("part").agg(*(c.alias(f"{n}_own") for n, c in sums.items()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    got = totals.select(F.col("part").alias("p"), *(F.coalesce(F.sum(f"{n}_own").over(earlier), F.lit(0)).alias(n) for n in sums))
    return rows.join(F.broadcast(got), F.col("part") == F.col("p")).drop("p")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target``.

    Sources take the weights in turn by code point order, null last. Resharing
    the excess until none is above ends at min(cap, level * weight) with one
    level for all, which running sums of caps and weights by cap per weight
    give. Sources may be as many as there are rows: all running numbers go by
    ranges of sources.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    s = _before(_ranged(s, *order), earlier=F.count("*"))
    turn = (F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1) % len(weights)
    w = s.select("source", "source_size", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int")).alias("w"))
    w = w.select("*", (most * F.col("source_size")).alias("cap"), (most * F.col("source_size") / F.col("w")).alias("ratio"))
    w = _before(_ranged(w, F.col("ratio")), caps=F.sum("cap"), ws=F.sum("w"))
    all_ = w.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    budget, weight = share * (all_["size"] or 0), all_["w"] or 0.0
    upto = Window.partitionBy("part").orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    below = F.col("caps") + F.sum("cap").over(upto) + F.col("ratio") * (F.lit(weight) - F.col("ws") - F.sum("w").over(upto))
    m = cut(w.select("source", "source_size", "w", "cap", (below < budget).alias("capped")))
    capped, w = F.col("capped"), F.col("w")
    left = m.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(capped, 0.0).otherwise(w)).alias("free")).first()
    rest = F.lit(budget - (left["used"] or 0.0)) * w / F.lit(left["free"] or 1.0)
    return m.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.least("cap", rest)).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``copies``, ``below``.

    A document is taken ``copies`` times, and once more if its hash is under
    ``below``. The first histogram sums sizes by source and the hash's first
    bits over all documents; each further one only over the boundary bucket of
    its source, until a bucket is one hash value; that goes in if the sum comes
    nearer to the target with it (a tie: it stays out).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = plan.select("*", whole.alias("copies")).select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"))
    mark = F.broadcast if fits(plan, BROADCAST_SOURCES) else lambda df: df
    edge = cut(part.select("source", "source_size", "target", "copies", "need", F.lit(0).cast("long").alias("start")))
    docs = sized.select("source", "size", "hash")
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        sums = docs.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        by = Window.partitionBy("source").orderBy("bucket")
        run = sums.select("source", "bucket", "size", F.sum("size").over(by).alias("upto"))
        keep = edge.select("source", "source_size", "target", "copies", "need", "start")
        met = run.withColumnRenamed("source", "s").join(mark(keep), F.col("s").eqNullSafe(F.col("source")))
        at = met.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("hit"))
        held = keep.join(at.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left")
        hit = F.col("hit")
        edge = cut(
            held.select(
                "source", "source_size", "target", "copies",
                F.when(hit.isNull(), F.col("need")).otherwise(F.col("need") - (hit["upto"] - hit["size"])).alias("need"),
                F.coalesce(F.shiftleft(hit["bucket"], shift), "start").alias("start"),
                hit["bucket"].alias("bucket"), hit["size"].alias("last"),
            )
        )
        if level + 1 < LEVELS:
            inside = edge.where("bucket IS NOT NULL").select(F.col("source").alias("s"), "bucket")
            docs = docs.join(mark(inside), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("hash", shift) == F.col("bucket")), "left_semi")
            docs = cut(docs)
    # need is now what the last value should add; without a bucket nothing exceeds the need, and all of the source is under it
    below = F.when(F.col("bucket").isNull(), F.when(F.col("need") > 0, F.lit(1 << 60)).otherwise(0)).otherwise(F.col("start") + F.when(F.col("last") - F.col("need") < F.col("need"), 1).otherwise(0))
    return edge.select("source", "source_size", "target", "copies", below.cast("long").alias("below"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with ``__pw_size``, ``__pw_source_size``, ``__pw_target`` and ``__pw_taken`` added.

    Documents are read twice: for their sizes, and for the result; they are not
    sorted, only histograms and sources are. Rows equal in id and text stand or
    fall together; a null id or text counts as empty. Whole texts are counted,
    however long. A source of no words has target 0. Other columns stay as they
    are, whatever their names but those. No rows: none.
    """
    sized = cut(docs.select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")))
    return apply_thresholds(docs, thresholds(sized, cut(targets(sized, weights, share, most))))


def apply_thresholds(docs: DataFrame, limits: DataFrame) -> DataFrame:
    of = limits.select(*(F.col(c).alias(f"__pw_{c}") for c in limits.columns))
    size = size_of(F.col("text"))
    copies = F.col("__pw_copies") + (hash_of(F.col("doc_id"), F.col("text")) < F.col("__pw_below")).cast("long")
    met = docs.join(small(of, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__pw_source")))
    out = met.select(docs["*"], size.alias("__pw_size"), "__pw_source_size", "__pw_target", copies.alias("__pw_copies"))
    return out.withColumn("__pw_taken", F.col("__pw_size") * F.col("__pw_copies"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    named = {"__pw_size": "size", "__pw_source_size": "source_size", "__pw_target": "target", "__pw_taken": "taken"}
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", *(F.col(a).alias(b) for a, b in named.items()))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s),
    r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio FROM w),
    f AS (SELECT *, (sum(cap) OVER a + ratio * (sum(w) OVER () - sum(w) OVER a)) < 1.5 * sum(source_size) OVER () AS capped FROM r
        WINDOW a AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap,
        (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM f),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
    c AS (SELECT d.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS need,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS last
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
    CAST(size * (copies + CASE WHEN need > 0 AND (upto <= need OR (upto - last <= need AND upto - need < need - (upto - last))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def taken(docs: DataFrame) -> DataFrame:
    """The documents of the mix: their columns, and as ``mix_copies`` and ``mix_words`` what is taken of them.

    Documents that are not taken, and those without words, go. Columns of these
    two names are replaced, so that a mix may be mixed again; all others stay as
    they are. No rows: none.
    """
    names = [f"`{c}`" for c in docs.columns if c not in ("mix_copies", "mix_words")]
    return mix(docs).where("__pw_taken > 0").select(*names, F.col("__pw_copies").alias("mix_copies"), F.col("__pw_taken").alias("mix_words"))
