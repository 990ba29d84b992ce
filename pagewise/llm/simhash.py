"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, Scratch, cut, octets, row_key, salted, small
from .components import connected_components

BITS = 64
#: Fingerprints of a bucket that are paired at once; a larger bucket goes a finer way.
AT_ONCE = 24
#: Shingles whose bits are held unpacked at a time.
BLOCK = 1 << 15
#: A text's minima come in bands; of two texts with Jaccard 0.8 no band is equal with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
#: Shingles whose images under all hashes are held at a time.
MIN_BLOCK = 1 << 11
#: Bits of a text's parities, which tell most unlike pairs without their sets.
PARITIES = 1024
#: Bits of a shingle's hash by which frequencies are counted to order shingles: a table of 4 MB at any input size.
BIN_BITS = 20
#: Up to so many rows of keys (some 50 MB) are broadcast, so that texts or bands of all documents are not shuffled.
FEW = 400_000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash over shingles of ``width`` words, repeats included.

    Bit j is 1 if it is set in more than half the shingles' XXH64. Fewer words
    than ``width`` make one shingle; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    h = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((h(s, seed) for s in shingles), dtype="<u8", count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="uint64").astype("int64")


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The different XXH64 of a text's shingles, ascending; fewer words than ``width`` make one shingle."""
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype="<u8"))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band of minima; an empty set has none."""
    if not len(hashes):
        return []
    parts = [(hashes[i : i + MIN_BLOCK, None] * TIMES + PLUS).min(axis=0) for i in range(0, len(hashes), MIN_BLOCK)]
    least = np.min(parts, axis=0).reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least)]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each residue of the hashes: whether their count is odd, as signed longs.

    Each hash that only one of two sets holds changes one bit, so at most as many
    bits differ as hashes: a bound that no pair within a difference exceeds.
    """
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


SKETCH = T.StructType([T.StructField("t", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
SET = T.StructType([T.StructField("set", T.ArrayType(T.LongType())), T.StructField("odd", T.ArrayType(T.LongType()))])


def sketch_column(text: Column, width: int) -> Column:
    """Of a text: hash of its words in order, number of different shingles, keys of its bands."""

    @F.pandas_udf(SKETCH)
    def sketch(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            words = _words(t)
            hashes = shingle_set(words, width)
            rows.append((_signed(xxhash.xxh64_intdigest(b" ".join(words))), len(hashes), band_keys(hashes)))
        return pd.DataFrame(rows, columns=SKETCH.names)

    return sketch(text)


def set_column(text: Column, width: int) -> Column:
    """Of a text: the hashes of its different shingles, and their parities."""

    @F.pandas_udf(SET)
    def shingled(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(_words(t), width) for t in text]
        return pd.DataFrame({"set": pd.Series([s.view("<i8") for s in sets], dtype=object), "odd": pd.Series([parities(s) for s in sets], dtype=object)})

    return shingled(text)


def _edges(segments: int, level: int) -> list[int]:
    """Bit offsets of the ring's segments, each halved ``level`` times until it is one bit."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    for _ in range(level):
        edges = sorted({*edges, *((a + b) // 2 for a, b in zip(edges, edges[1:]))})
    return edges


def _masks(segments: int, level: int = 0) -> list[int]:
    """Of each segment: its bits, as a 64-bit number."""
    edges = _edges(segments, level)
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(diff: Column, masks: list[int], distance: int) -> Column:
    """Pigeonring: some start on the ring has every chain of 1..m consecutive
    segments within its share, length * distance / m, of the differing bits."""
    m = len(masks)
    d = [F.bit_count(diff.bitwiseAND(F.lit(_signed(x)))) for x in masks]
    starts = []
    for i in range(m):
        sums = [reduce(lambda a, b: a + b, [d[(i + j) % m] for j in range(n)]) <= n * distance // m for n in range(1, m + 1)]
        starts.append(reduce(lambda a, b: a & b, sums))
    return reduce(lambda a, b: a | b, starts)


def _finer(segments: int, level: int, distance: int) -> list[tuple[int, int]]:
    """Free bits of each bucket at ``level``, with those of the buckets at the next level inside it.

    A bucket leaves ``distance`` segments free; halved, these are up to twice as
    many, and a pair that differs in ``distance`` bits lies in as many of them.
    """
    halves = _masks(segments, level + 1)
    out = []
    for free in combinations(_masks(segments, level), distance):
        inside = [h for h in halves if any(h & f for f in free)]
        out += [(_signed(sum(free)), _signed(sum(c))) for c in combinations(inside, distance)]
    return out


def near_fingerprints(fps: DataFrame, distance: int = 2, segments: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Edges ``a``, ``b`` (some twice): all pairs of fingerprints within ``distance`` of each other.

    ``fps``: one row per fingerprint (``fp``). The ring has ``segments`` segments
    (distance + 2 unless given). With ``distance`` differing bits at most as many
    segments differ, so each viable chain of the ring lies over equal segments:
    the others' bits are a bucket's key, and only fingerprints that share one
    meet. There the chain condition prunes before the whole distance is counted.
    A bucket of more than ``at_once`` fingerprints is dealt to the buckets of a
    ring whose segments are half as long, again and again: there as few segments
    are free, so ever fewer bits, and at segments of one bit a bucket holds
    2 ** distance fingerprints at most. So rows and pairs stay in proportion to
    the fingerprints, whatever the size of a group, and no pair is lost.
    """
    spark = fps.sparkSession
    segments = segments or distance + 2
    ring = _masks(segments)
    free = [_signed(sum(c)) for c in combinations(ring, distance)]
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(diff) <= distance) & _chain(diff, ring, distance)
    key = F.col("fp").bitwiseAND(F.bitwise_not("free"))
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, free))).alias("free")).select("free", key.alias("key"), "fp")
    found, level = [], 0
    while True:
        sizes = rows.groupBy("free", "key").agg(F.count("*").alias("n")).where("n > 1")
        held = cut(rows.join(sizes, ["free", "key"]).select("free", "key", "fp", "n"))
        last = len(_masks(segments, level)) == BITS
        fitting = held if last else held.where(F.col("n") <= at_once)
        together = fitting.groupBy("free", "key").agg(F.collect_list("fp").alias("all"))
        pairs = together.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")
        found.append(pairs.where(near))
        crowded = held.where(F.col("n") > at_once)
        if last or crowded.isEmpty():
            return reduce(DataFrame.union, found)
        inside = spark.createDataFrame(pd.DataFrame(_finer(segments, level, distance), columns=["free", "next"]))
        split = crowded.select("free", "fp").join(F.broadcast(inside), "free").select("fp", F.col("next").alias("free")).distinct()
        rows, level = split.select("free", key.alias("key"), "fp"), level + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row per document: ``id``, ``fp`` (signed long), ``component`` (least id it reaches).

    Exact copies share a fingerprint and meet once, as one node. Null and empty
    texts have fingerprint 0 and link like any other; null ids never become a
    component's name unless it has no other. Whole texts are read, however long;
    ties of ids don't matter, as rows of one id are rows of their own. Repeated
    rows stay. Other columns are not read, so their names don't matter. No rows: none.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(octets(text_col)).alias("fp")))
    return with_components(rows, distance)


def with_components(rows: DataFrame, distance: int = 2) -> DataFrame:
    """``rows`` (``id``, ``fp`` and others) with ``root`` (the least fingerprint reached) and ``component``."""
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_fingerprints(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = cut(roots.join(fps, "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = salted(linked, least, "root", "fp").select("fp", "root", "component")
    alone = F.col("root").isNull()
    named = fps.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component")).alias("component"))
    return rows.join(cut(named), "fp")


def _bins(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - BIN_BITS)


def rarity_column(spark: SparkSession, shingles: Column, counts: np.ndarray) -> Column:
    """Mean of one over the frequency of a set's shingles: the less, the more of the set is common."""
    held = spark.sparkContext.broadcast(counts)

    @F.pandas_udf(T.DoubleType())
    def rarity(sets: pd.Series) -> pd.Series:
        return pd.Series([float((1 / held.value[_bins(np.asarray(x, dtype="<i8").view("<u8"))]).mean()) for x in sets], dtype="float64")

    return rarity(shingles)


def prefix_column(spark: SparkSession, shingles: Column, counts: np.ndarray, similarity: float) -> Column:
    """The rarest shingles of a set, by bin frequency and hash, as many as a similar set must share one of."""
    held = spark.sparkContext.broadcast(counts)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prefix(sets: pd.Series) -> pd.Series:
        out = []
        for x in sets:
            h = np.asarray(x, dtype="<i8").view("<u8")
            n = len(h) - int(np.ceil(len(h) * similarity - 1e-9)) + 1
            out.append(h[np.lexsort((h, held.value[_bins(h)]))[:n]].view("<i8"))
        return pd.Series(out, dtype=object)

    return prefix(shingles)


class SimilarTexts:
    """Links between texts whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    ``sketches``: one row per text (``t``) with its number of shingles ``n`` and
    band ``keys``. ``texts``: ``t`` and ``text`` of any of them, in any order and
    number. Texts that share a band meet. In each bucket all first meet one of
    them only, the one whose shingles are the most common (of copies with
    changes, the least changed), so a group makes rows in proportion to its
    members. Those of a bucket that links do not join by then meet each
    other, in a bucket of up to ``AT_ONCE`` texts all of them, in a larger one
    those that share one of their rarest shingles: similar sets must, and texts
    that have a passage in common and are otherwise unlike do not. What meets is
    decided on the whole sets, unless sizes or parities show that these differ
    in too much.
    """

    def __init__(self, sketches: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float = 0.8, width: int = 5):
        self.sketches, self.texts, self.scratch, self.similarity, self.width = sketches, texts, scratch, similarity, width

    def edges(self) -> DataFrame:
        """Edges ``a``, ``b`` that connect what all links connect."""
        keep, spark = self.scratch.keep, self.sketches.sparkSession
        rows = self.sketches.where("n > 0").select(F.explode("keys").alias("key"), "t", "n")
        buckets = keep(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        held = keep(rows.join(small(buckets, FEW), "key").select("key", "t", "n", "size"))
        met = keep(held.select("t").distinct())
        texts = self.texts.join(small(met, FEW), "t", "left_semi").select("t", set_column(F.col("text"), self.width).alias("s"))
        self.sets = keep(texts.groupBy("t").agg(F.first("s").alias("s")).select("t", "s.*"))
        self.counts = self._frequencies()
        common = cut(self.sets.select("t", rarity_column(spark, F.col("set"), self.counts).alias("rarity")))
        hubs = keep(held.join(common, "t").groupBy("key").agg(F.min(F.struct("rarity", "t", "n")).alias("hub")))
        found = self.alike(_pairs(held.join(small(hubs, FEW), "key").where("t <> hub.t"), "t", "n", "hub.t", "hub.n"))
        # Which bucket still holds texts that links do not join?
        roots = cut(connected_components(found)).withColumnRenamed("node", "t")
        placed = held.join(roots, "t", "left").select("key", "t", "n", "size", F.coalesce("root", "t").alias("root"))
        apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        placed = keep(placed.join(small(cut(apart), FEW), "key"))
        self.scratch.free(buckets, held, met, hubs)
        x, y = (placed.where(F.col("size") <= AT_ONCE).select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("t", "n", "root"))) for side in "xy")
        few = x.join(y, (x["key"] == y["key"]) & (F.col("x_root") < F.col("y_root")))
        crowded = cut(placed.where(F.col("size") > AT_ONCE).select("t", "n", "root").distinct())
        pairs = _pairs(few, "x_t", "x_n", "y_t", "y_n")
        if not crowded.isEmpty():
            pairs = pairs.union(self.rarest(crowded))
        return found.union(self.alike(pairs))

    def _frequencies(self) -> np.ndarray:
        """How many sets have a shingle in each bin of hashes (1 at least): of one size at any input."""
        of = F.shiftrightunsigned("x", 64 - BIN_BITS)
        table = self.sets.select(F.explode("set").alias("x")).groupBy(of.alias("bin")).agg(F.count("*").alias("n")).toArrow()
        counts = np.ones(1 << BIN_BITS, dtype=np.int32)
        counts[table.column("bin").to_numpy()] = np.minimum(table.column("n").to_numpy(), np.iinfo(np.int32).max)
        return counts

    def rarest(self, texts: DataFrame) -> DataFrame:
        """Pairs of ``texts`` (``t``, ``n``, ``root``) of different roots that may be similar, by prefix filtering.

        All shingles have one order, the rarer first. Of two similar sets of m and
        n shingles, (m + n) * s / (1 + s) or more are shared, so the first shared
        one has as many from it on in either set. Any order gives all such pairs;
        rarity, told by bins of hashes, keeps others out.
        """
        s = self.similarity
        sets = self.sets.join(small(texts.select("t"), FEW), "t", "left_semi")
        first = sets.select("t", F.posexplode(prefix_column(sets.sparkSession, F.col("set"), self.counts, s)).alias("i", "x")).join(small(texts, FEW), "t")
        first = cut(first.select("x", "t", "n", "root", (F.col("n") - F.col("i")).alias("left")))
        apart = first.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("x")
        first = cut(first.join(small(cut(apart), FEW), "x"))
        a, b = (first.select("x", *(F.col(c).alias(f"{side}_{c}") for c in ("t", "n", "root", "left"))) for side in "ab")
        lesser = (F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_t") < F.col("b_t"))
        enough = F.least("a_left", "b_left") >= (F.col("a_n") + F.col("b_n")) * (s / (1 + s)) - 1e-9
        # Of equal or greater sets the lesser needs 2s / (1 + s) of its own; known before the join.
        short = a.where(F.col("a_left") >= F.col("a_n") * (2 * s / (1 + s)) - 1e-9)
        met = short.join(b, "x").where(lesser & enough & (F.col("a_root") != F.col("b_root")) & (F.col("a_n") >= s * F.col("b_n") - 1e-9))
        return _pairs(met, "a_t", "a_n", "b_t", "b_n")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``a``, ``b``, sizes ``low``, ``high``) that are similar."""
        keep, s = self.scratch.keep, self.similarity
        odd = self.sets.select("t", "odd")
        pairs = pairs.where(F.col("low") >= s * F.col("high") - 1e-9).distinct()
        both = pairs.join(odd.select(F.col("t").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("t").alias("b"), F.col("odd").alias("ob")), "b")
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(PARITIES // 64)])
        # Of sizes m and n, similar sets differ in (m + n) * (1 - similarity) / (1 + similarity) at most.
        left = keep(both.where(apart <= (F.col("low") + F.col("high")) * ((1 - s) / (1 + s)) + 1e-9).select("a", "b"))
        both = left.join(self.sets.select(F.col("t").alias("a"), F.col("set").alias("sa")), "a").join(self.sets.select(F.col("t").alias("b"), F.col("set").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return keep(both.where(common >= s * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"))


def _pairs(rows: DataFrame, a: str, na: str, b: str, nb: str) -> DataFrame:
    """Pairs, the lesser node first, and the sizes of their sets."""
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.least(na, nb).alias("low"), F.greatest(na, nb).alias("high"))


def _joined(rows: DataFrame, docs: DataFrame, scratch: Scratch, text_col: str, similarity: float, width: int) -> DataFrame:
    """``rows`` (``root``, ``t``, sketches and row keys) with the roots that links of similar texts connect as one."""
    keep = scratch.keep
    least = F.struct("n", *ROW)
    sketches = keep(rows.groupBy("t").agg(F.min(least).alias("of"), F.first("keys").alias("keys"), F.min("root").alias("root")).select("t", "of.*", "keys", "root"))
    # One row of each text is read again, found by its key.
    texts = docs.select(*row_key(docs.columns, docs.schema), octets(text_col).alias("text")).join(small(sketches.select("t", *ROW), FEW), ROW)
    similar = SimilarTexts(sketches.select("t", "n", "keys"), texts.select("t", "text"), scratch, similarity, width).edges()
    # A text of its words only has one fingerprint, so one root.
    of = sketches.select("t", "root")
    ends = similar.join(of.select(F.col("t").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("t").alias("b"), F.col("root").alias("rb")), "b")
    above = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("above"))
    return salted(rows, above, "root", "__pw_row", "left").withColumn("root", F.coalesce("above", "root")).drop("above")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, similarity: float | None = None, width: int = 5) -> DataFrame:
    """Of each group of near-duplicates the row with the least id (null ids last; ties: by hash of the row).

    Links are fingerprints within ``distance`` and, with a ``similarity``, also
    texts whose sets of shingles of ``width`` words have that Jaccard similarity.
    Rows that are equal in every column count as one; null and empty texts are
    one group; whole texts are read, however long. Columns, of any type, stay as
    they are and may have any name not beginning with ``__pw_``. No rows: none.
    """
    names = [f"`{c}`" for c in docs.columns]
    scratch = Scratch(docs.sparkSession, "near")
    key = row_key(docs.columns, docs.schema)
    of = [F.col(f"`{id_col}`").alias("id"), fingerprint_udf(octets(f"`{text_col}`")).alias("fp"), *key]
    if similarity is None:
        rows = with_components(scratch.keep(docs.select(*of)), distance)
    else:
        rows = scratch.keep(docs.select(*of, sketch_column(octets(f"`{text_col}`"), width).alias("s")).select("id", "fp", *ROW, "s.*"))
        sketched, rows = rows, scratch.keep(with_components(rows, distance))
        scratch.free(sketched)
        rows = _joined(rows, docs, scratch, f"`{text_col}`", similarity, width)
    rows = scratch.keep(rows.select("root", "id", *ROW))
    order = F.struct(F.col("id").isNull(), "id", *ROW)
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select("best.*")
    kept = rows.groupBy(*ROW).agg(F.count("*").alias("n")).join(best.select(*ROW, F.lit(True).alias("best")), ROW, "left")
    # Most rows stay: those that go, and those that repeat, are few or many, and only they need be looked up.
    told = cut(kept.where("best IS NULL OR n > 1").select(*ROW, F.col("best").isNotNull().alias("again")))
    scratch.drop()
    marked = docs.withColumns({c: k for c, k in zip(ROW, key)})
    plain = marked.join(small(told, FEW), ROW, "left_anti")
    again = told.where("again")
    if again.isEmpty():
        return plain.select(*names)
    once = marked.join(small(again, FEW), ROW, "left_semi").dropDuplicates(ROW)
    return plain.union(once).select(*names)
