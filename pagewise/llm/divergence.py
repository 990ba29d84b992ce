"""Quality rules by distribution divergence from language references."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, octets, small
from .textstats import WORDS_OF, base_counts, common_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Texts of fewer words are not compared, nor do they shape a reference.
LEAST_WORDS = 40
#: Documents that the pooled reference weighs in each language's own.
POOLED = 1.0
#: Greatest distances, beyond sampling noise, that pass: of either histogram, and of both together.
CHAR_LIMIT, WORD_LIMIT, SUM_LIMIT = 0.24, 0.22, 0.33
#: Times the expected divergence of a text that follows its reference, which is not held against it.
NOISE = 1.5
#: Languages whose references are broadcast; more are joined by shuffle.
BROADCAST_LANGS = 10_000

STATS = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in COUNTS),
        T.StructField("chars", T.ArrayType(T.LongType())),
        T.StructField("common", T.ArrayType(T.LongType())),
    ]
)


@F.pandas_udf(STATS)
def stats_udf(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = []
    for t, name in zip(text, lang):
        words, classes, counts = base_counts(t)
        rows.append((*counts, classes.tolist(), common_counts(words, name).tolist()))
    return pd.DataFrame(rows, columns=STATS.names)


def _shares(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(histogram, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _beyond_noise(p: Column, q: Column, n: Column) -> Column:
    """Distance of an observed histogram of n things from a reference, less what chance alone brings.

    A bin of share q is off by about 1 / (8 n ln 2) in divergence, and by q / 2 if it stays empty.
    """
    each = 1 / (8 * math.log(2) * F.greatest(n, F.lit(1)))
    noise = F.aggregate(F.transform(q, lambda x: F.least(x / 2, each)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(_distance(p, q) ** 2 - NOISE * noise, F.lit(0.0)))


def failed() -> Column:
    """The base rule's verdict."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def references(stats: DataFrame) -> DataFrame:
    """Of each language: mean shares of character classes and common words over all its documents.

    Documents of LEAST_WORDS words that pass the base rule count; means are of
    shares, so that a very long document weighs no more than another. Each
    language's means are shrunk toward those of all languages as if these were
    ``POOLED`` documents more (of common words: their share in all, dealt evenly
    over the language's list), so a language of few documents needs no rule of
    its own. Bins are a fixed number, so sums by language and bin stay small.
    """
    long = stats.where((F.col("n_words") >= LEAST_WORDS) & ~failed())
    bins = lambda name: F.posexplode(_shares(F.col(name)))
    both = long.select("lang", F.lit("chars").alias("of"), F.size("chars").alias("size"), bins("chars").alias("bin", "x"))
    both = both.union(long.select("lang", F.lit("common").alias("of"), F.size("common").alias("size"), bins("common").alias("bin", "x")))
    sums = cut(both.groupBy("lang", "of", "size", "bin").agg(F.sum("x").alias("x"), F.count("*").alias("n")))
    # Of common words only their list's share and that of the last bin, all other words, compare across languages.
    other = (F.col("of") == "common") & (F.col("bin") == F.col("size") - 1)
    alike = F.when(F.col("of") == "chars", F.col("bin")).when(other, -1).otherwise(-2)
    pool = sums.groupBy("of", alike.alias("alike")).agg(F.sum("x").alias("px")).alias("p")
    rows = sums.groupBy("of").agg(F.sum(F.when(F.col("bin") == 0, F.col("n"))).alias("pn")).alias("t")
    pool = pool.join(rows, "of").select(F.col("of").alias("p_of"), F.col("alike").alias("p_alike"), (F.col("px") / F.col("pn")).alias("p"))
    met = sums.withColumn("alike", alike).join(F.broadcast(pool), (F.col("of") == F.col("p_of")) & (F.col("alike") == F.col("p_alike")))
    prior = F.when(F.col("alike") == -2, F.col("p") / (F.col("size") - 1)).otherwise(F.col("p"))
    means = met.select("lang", "of", "bin", ((F.col("x") + POOLED * prior) / (F.col("n") + POOLED)).alias("x"))
    array = lambda of: F.transform(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct("bin", "x")))), lambda s: s["x"])
    return means.groupBy("lang").agg(array("chars").alias("ref_chars"), array("common").alias("ref_common"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``id``, the base counts, ``base_failed``, ``kept``, and beyond noise
    ``char_distance`` and ``word_distance`` (null where a guard holds).

    Each text is read once; its counts are kept, references come from the
    counts of all documents, and distances from both. Null and empty texts have
    no words, so they fail the base rule; a null or unknown language is a
    language of its own, with the common words of all; a distance just at its
    limit passes. Whole texts are read, however long. Repeated rows stay; other
    columns are not read, so their names don't matter. No rows: none.
    """
    known = F.col(lang_col).isin(*WORDS_OF)
    rows = docs.select(F.col(id_col).alias("id"), F.when(known, F.col(lang_col)).alias("lang"), stats_udf(octets(text_col), F.when(known, F.col(lang_col))).alias("s"))
    stats = cut(rows.select("id", "lang", "s.*"))
    refs = small(references(stats).withColumnRenamed("lang", "of_lang"), BROADCAST_LANGS)
    met = stats.join(refs, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    judged = (F.col("n_words") >= LEAST_WORDS) & F.col("ref_chars").isNotNull()
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    d = met.select(
        "id", *COUNTS,
        F.when(judged, _beyond_noise(_shares(F.col("chars")), F.col("ref_chars"), n_chars)).alias("char_distance"),
        F.when(judged, _beyond_noise(_shares(F.col("common")), F.col("ref_common"), F.col("n_words"))).alias("word_distance"),
        failed().alias("base_failed"),
    )
    c, w = F.col("char_distance"), F.col("word_distance")
    strange = (c > CHAR_LIMIT) | (w > WORD_LIMIT) | (c + w > SUM_LIMIT)
    return d.select("id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"), "char_distance", "word_distance")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the distances after them."""
    return verdicts(docs).withColumnRenamed("id", "doc_id")
