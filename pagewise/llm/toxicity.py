"""Toxicity: character n-grams, scaled by naive Bayes log-count ratios, in a linear classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, octets

NGRAMS = (3, 4, 5)
HASH_BITS = 18
SPACE = 32
#: An n-gram counts if its log-count ratio is so many standard errors from 0.
SURE = 3.0


def ngram_ids(text: bytes) -> np.ndarray:
    """Hashes of the distinct character n-grams of the lower-cased text, sorted.

    An n-gram lies in one word with a blank before and behind it. Each word
    counts once, so the work follows a text's vocabulary; whole texts are read.
    """
    words = set(text.decode("utf-8", "replace").lower().split())
    if not words:
        return np.empty(0, dtype=np.int32)
    chars = np.frombuffer((" " + " ".join(sorted(words)) + " ").encode("utf-32-le"), dtype=np.uint32)
    inner = np.concatenate(([0], np.cumsum(chars == SPACE, dtype=np.int32)))
    seen = np.zeros(1 << HASH_BITS, dtype=bool)
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(chars), dtype=np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            if n > len(chars):
                break
            hashed = (hashed[: len(chars) - n + 1] * np.uint32(0x01000193)) ^ (chars[n - 1 :] * np.uint32(0x9E3779B1))
            if n in NGRAMS:
                k = len(hashed)
                whole = inner[n - 1 : n - 1 + k] == inner[1 : 1 + k]
                mixed = (hashed[whole] ^ (hashed[whole] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                seen[mixed >> np.uint32(32 - HASH_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
def ngram_ids_udf(text: bytes):
    return ngram_ids(text).tolist()


@dataclass
class Model:
    """``weights`` holds regression weight times log-count ratio for each hash."""

    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        z = self.bias + float(self.weights[ngram_ids(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def constant(share: float) -> Model:
    """The same score for every text."""
    return Model(np.zeros(1 << HASH_BITS, dtype=np.float32), float(np.log(share / (1 - share))))


def ratios(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every n-gram, from the numbers of texts of each class that have it (each one more),
    and whether it is ``SURE`` standard errors from 0."""
    p, q = toxic + 1.0, clean + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return ratio, np.abs(ratio) > SURE * np.sqrt(1 / p + 1 / q)


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, share: float, steps: int = 400, l2: float = 0.1) -> Model:
    """Logistic regression on presences scaled by their ratios; both classes weigh alike.

    Text ``row[i]`` has n-gram ``col[i]``. ``share``: the toxic share where the
    model will be used, as the rows given are not dealt so.
    """
    used, at = np.unique(col, return_inverse=True)
    r = ratio[used]
    x = r[at]
    w, b = np.zeros(len(used)), np.log(y.mean() / (1 - y.mean()))
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    norms = np.bincount(row, x * x, minlength=len(y))
    lipschitz = 0.25 * float((balance * (norms + 1)).sum()) + l2 / len(y)
    prev, prev_b, t = w, b, 1.0
    for _ in range(steps):  # accelerated gradient; every row in every step
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = w + (old - 1) / t * (w - prev), b + (old - 1) / t * (b - prev_b)
        z = np.bincount(row, x * v[at], minlength=len(y)) + vb
        g = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.bincount(at, x * g[row], minlength=len(used)) + l2 / len(y) * v
        prev, prev_b = w, b
        w, b = v - grad / lipschitz, vb - g.sum() / lipschitz
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    weights[used] = w * r
    return Model(weights, float(b + np.log(share / (1 - share))))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", each: int = 1500) -> tuple[DataFrame, float]:
    """``t``, ``y`` of at most ``each`` labelled documents per class, and the class share of all labels.

    Labels count only where crc32 of the id as text, modulo 5, is not 0. The
    bound on a class is the documented size of the training sample, taken by
    hash of the id; the share is of all labels that may be learnt from. Of rows
    with one id one text counts (that of the least hash).
    """
    open_ = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    open_ = open_.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    share = open_.agg(F.sum("y"), F.count("*")).first()
    order = F.xxhash64("id")
    some = open_.where("y = 1").orderBy(order, "id").limit(each).union(open_.where("y = 0").orderBy(order, "id").limit(each))
    texts = docs.select(F.col("doc_id").alias("id"), octets("text").alias("t")).join(F.broadcast(some), "id")
    once = texts.groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    return once.select("t", "y"), ((share[0] or 0) + 0.5) / (share[1] + 1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", each: int = 1500) -> Model:
    """The model from a sample of ``each`` labelled rows a class at most.

    N-grams are counted by class in the engine, of which the driver gets one row
    per hash at most; of the texts it gets only the n-grams whose ratio counts.
    Without rows of both classes the score is the class share, (toxic + 0.5) /
    (rows + 1.5), for every text.
    """
    found, share = training_rows(docs, labels, label_col, each)
    rows = cut(found.select(ngram_ids_udf("t").alias("ids"), "y"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return constant((n.get(1, 0) + 0.5) / (sum(n.values()) + 1.5))
    counted = rows.select(F.explode("ids").alias("i"), "y").groupBy("i").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).toArrow()
    counts = np.zeros((2, 1 << HASH_BITS))
    for c, name in enumerate(("clean", "toxic")):
        counts[c, counted.column("i").to_numpy()] = counted.column(name).to_numpy()
    ratio, sure = ratios(counts[1], counts[0])
    held = rows.sparkSession.sparkContext.broadcast(sure)

    @F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
    def among(ids):
        ids = np.asarray(ids, dtype=np.int64)
        return ids[held.value[ids]].tolist()

    got = rows.select(among("ids").alias("ids"), "y").toArrow()
    ids = got.column("ids").combine_chunks()
    row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
    return fit(row, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), got.column("y").to_numpy().astype(float), ratio, share)


def score_column(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """The model's score of a text column; the weights (1 MB at any input size) are broadcast."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in text], dtype="float64")

    return scored(octets(text_col))


def scores(docs: DataFrame, labels: DataFrame, each: int = 1500) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null and empty texts get the score of no evidence; whole texts are scored,
    however long. A score of just 0.5 is predicted 1. Repeated rows stay, each
    scored alike; a null id is never held out. Other columns are not read, so
    their names don't matter. No rows: none.
    """
    model = train(docs, labels, each=each)
    out = docs.select("doc_id", score_column(docs.sparkSession, model).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, each: int = 1500) -> DataFrame:
    """Rows that score under 0.5, columns as they are, whatever their names; see ``scores`` for odd rows."""
    model = train(docs, labels, each=each)
    return docs.where(score_column(docs.sparkSession, model) < 0.5)
