"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, cut, octets, row_key, small

WINDOW = 10
#: UTF-8 octets: A-Z in lower case, other ASCII but digits and letters to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

DIGEST = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "first", "past")]))),
    ]
)
#: Texts with findings in one of several blocks that are broadcast; more are joined by shuffle.
BROADCAST_FOUND = 100_000


def windows(text: bytes, size: int = WINDOW) -> set[str]:
    """Normalised windows of ``size`` words; of fewer, but not none, the whole is one."""
    words = text.translate(FOLD).split()
    n = len(words)
    return {b" ".join(words[i : i + size]).decode("latin-1") for i in range(max(1, n - size + 1))} if words else set()


def blocks(items: Iterator[tuple[str, bytes]], size: int, most: int) -> Iterator[dict[str, list[str]]]:
    """Windows with the items that have them, in blocks of about ``most`` octets; a large item is split too."""
    out: dict[str, list[str]] = {}
    held = 0
    for item, text in items:
        for w in windows(text, size):
            if out and held + len(w) > most:
                yield out
                out, held = {}, 0
            out.setdefault(w, []).append(item)
            held += len(w)
    yield out


class Scanner:
    """The automaton; built from the windows once in each worker."""

    def __init__(self, found: dict[str, list[str]]):
        self.found = found
        self.machine = None

    def __getstate__(self):
        return self.found

    def __setstate__(self, found):
        self.__init__(found)

    def build(self):
        self.machine = ahocorasick.Automaton()
        for i, (w, items) in enumerate(self.found.items()):
            self.machine.add_word(f" {w} ", (i, len(w.split(" ")), len(w) + 2, items))
        if self.found:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words; runs of hit words as (first, past last); items found."""
        if self.machine is None:
            self.build()
        words = text.translate(FOLD).split()
        if not words or not self.found:
            return len(words), [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        starts: list[int] = []
        runs: list[list[int]] = []
        items: set[str] = set()
        seen: set[int] = set()  # windows, so that the names of each are added once
        for end, (i, n, length, names) in self.machine.iter(line):
            if not starts:
                starts = np.concatenate(([1], np.cumsum([len(w) + 1 for w in words])[:-1] + 1)).tolist()
            if i not in seen:
                seen.add(i)
                items.update(names)
            first = bisect_right(starts, end - length + 2) - 1
            runs.append([first, first + n])
        merged: list[list[int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return len(words), [(a, b) for a, b in merged], sorted(items)


def source_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets, in the original text, of runs of words."""
    if not runs:
        return []
    octet = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    word = np.concatenate(([False], octet != 32, [False]))
    step = np.flatnonzero(word[1:] != word[:-1])
    begin, end = step[::2], step[1::2]
    points = np.concatenate(([0], np.cumsum((octet & 0xC0) != 0x80)))
    return [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[dict[str, list[str]]]:
    """The benchmark's windows, streamed to the driver a partition at a time, a block in memory."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), octets("text"))
    return blocks(((r[0], bytes(r[1])) for r in rows.toLocalIterator()), size, most)


def hits_column(spark: SparkSession, found: dict[str, list[str]], text_col: str = "text") -> Column:
    """Struct of words, hit words, items and spans of each text, against one block.

    A span is a run of hit words: its code points ``start`` to ``end`` in the
    source, and its words ``first`` to ``past``, ends exclusive.
    """
    held = spark.sparkContext.broadcast(Scanner(found))

    @F.pandas_udf(DIGEST)
    def hits(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            n, runs, items = held.value.scan(t)
            spans = [{"start": a, "end": b, "first": i, "past": j} for (a, b), (i, j) in zip(source_spans(t, runs), runs)]
            rows.append((n, sum(b - a for a, b in runs), items, spans))
        return pd.DataFrame(rows, columns=DIGEST.names)

    return hits(octets(text_col))


def joined(spans: list[dict]) -> list[dict]:
    """Runs of several blocks as runs of their union."""
    out: list[dict] = []
    for s in sorted(({k: int(v) for k, v in s.items()} for s in spans), key=lambda s: (s["first"], s["past"])):
        if out and s["first"] <= out[-1]["past"]:
            if s["past"] > out[-1]["past"]:
                out[-1] |= {"past": s["past"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


@F.pandas_udf(DIGEST)
def merged_udf(n_words: pd.Series, items: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Blocks' findings for one text as one: items together, words hit in any block once."""
    rows = []
    for n, names, parts in zip(n_words, items, spans):
        of = joined([s for part in parts for s in part])
        rows.append((n, sum(s["past"] - s["first"] for s in of), sorted({x for part in names for x in part}), of))
    return pd.DataFrame(rows, columns=DIGEST.names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_mb: int = 64, text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``n_hit``, ``items``, ``spans``.

    Every text is scanned whole, however long, once for each block of
    ``block_mb`` MB of windows: a usual benchmark is one block, so one
    automaton. Of a larger one each block's findings, of the texts that have
    any, are kept in reliable storage by row key before the next is scanned: so
    workers hold one automaton at a time, and texts are neither written nor, if
    findings are few, moved. Null and empty texts have no words and no hits;
    null items and items without words match nothing; repeated rows stay, each
    with its findings; overlapping windows count a word once. Other columns stay
    as they are; one of the name ``out`` is replaced. An empty benchmark hits
    nothing; no documents: no rows.
    """
    spark = docs.sparkSession
    todo = benchmark_blocks(benchmark, window, block_mb << 20)
    found, more = next(todo), next(todo, None)
    if more is None:
        return docs.withColumn(out, hits_column(spark, found, text_col))
    key, parts = row_key(docs.columns, docs.schema), []
    while found is not None:
        block = docs.select(*key, hits_column(spark, found, text_col).alias("h")).where(F.size("h.items") > 0)
        parts.append(cut(block.dropDuplicates(ROW)))
        found, more = more, next(todo, None)
    all_ = reduce(DataFrame.union, parts).groupBy(*ROW).agg(F.first("h.n_words").alias("n"), F.collect_list("h.items").alias("i"), F.collect_list("h.spans").alias("s"))
    told = cut(all_.select(*ROW, merged_udf("n", "i", "s").alias("__pw_found")))
    marked = docs.withColumns({c: k for c, k in zip(ROW, key)}).join(small(told, BROADCAST_FOUND), ROW, "left")
    clean = hits_column(spark, {}, text_col)  # words are counted, nothing is found
    return marked.withColumn(out, F.coalesce("__pw_found", clean)).drop("__pw_found", *ROW)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    got = contamination(docs.select("doc_id", "text"), benchmark)
    items = F.array_join(F.array_sort("hits.items"), ",")
    return got.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a hit, columns as they are; see ``contamination`` for odd rows."""
    return contamination(docs, benchmark, out="__pw_hits").where("__pw_hits.n_hit = 0").drop("__pw_hits")




_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t FROM b, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
    d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    v AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM d, (SELECT DISTINCT k FROM p), range(1, len(w) - k + 2) r(i)),
    h AS (SELECT doc_id, i, v.k, item FROM v JOIN p ON v.k = p.k AND v.t = p.t),
    n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(0, k) r(j) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
