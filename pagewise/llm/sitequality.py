"""Quality by hierarchical empirical Bayes: a document's evidence with its host's and path's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, octets, small
from .textstats import BEYOND_ASCII, BEYOND_LATIN, base_counts, common_counts

#: Sites (host, path) whose posteriors are broadcast; more are joined by shuffle.
BROADCAST_SITES = 100_000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def features(text: bytes) -> list[float]:
    """Shares that tell prose from junk, each 0 to 1 or a logarithm."""
    words, k, (n, chars, symbols, dup, repeat) = base_counts(text)
    total = max(1, int(k.sum()))
    letters = max(1, int(k[0] + k[1] + k[BEYOND_ASCII:].sum()))
    lines = max(1, int(k[4]) + 1)
    some = max(1, n)
    return [
        np.log1p(n), chars / some / 10, k[1] / letters, k[2] / total, k[5] / total,
        min(1.0, symbols / some), k[7] / total, k[BEYOND_LATIN:].sum() / total, dup / lines, repeat / some,
        len(set(words)) / some, (n - int(common_counts(words, None)[-1])) / some,
        sum(w.endswith((b".", b"!", b"?")) for w in words) / some, np.log1p(n / lines),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[float(v) for v in features(t)] for t in text], dtype=object)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps on standardised features; weights for the raw ones.

    Without rows of both classes: no weights, and the class share smoothed by one half.
    """
    d = x.shape[1] if x.ndim == 2 else 0
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(d), float(np.log(p / (1 - p)))
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    ridge = l2 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge, z.T @ (p - y) / len(y) + l2 * w)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame) -> float:
    """Documents that a parent's mean weighs for a child: variance within children over
    variance between them beside their own parent, by the method of moments.

    ``groups``: ``n``, ``s``, ``ss`` of each child and ``pn``, ``ps`` of its parent.
    """
    m = F.col("ps") / F.col("pn")
    g = groups.agg(
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("inside"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - m) ** 2).alias("between"),
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(1 / F.col("parts")).alias("parents"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("own"),
    ).first()
    if not g["n"] or g["n"] <= g["k"] or g["k"] <= g["parents"]:
        return STRONGEST
    within = g["inside"] / (g["n"] - g["k"])
    var = (g["between"] - (g["k"] - g["parents"]) * within) / max(1e-9, g["n"] - g["own"])
    return float(min(STRONGEST, max(WEAKEST, within / var))) if var > 0 else STRONGEST


def training_rows(rows: DataFrame, labels: DataFrame, label_col: str, each: int) -> DataFrame:
    """``x``, ``y`` of at most ``each`` labelled documents a class, by hash of the id.

    Ids whose crc32 as text divides by 5 are held out. Of rows with one id one counts.
    """
    l = labels.select(F.col("doc_id").alias("lid"), F.col(label_col).cast("double").alias("y")).where("lid IS NOT NULL AND y IS NOT NULL")
    l = l.where(F.crc32(F.col("lid").cast("string")) % 5 != 0).groupBy("lid").agg(F.max("y").alias("y"))
    order = F.xxhash64("lid")
    some = l.where("y >= 0.5").orderBy(order, "lid").limit(each).union(l.where("y < 0.5").orderBy(order, "lid").limit(each))
    return rows.join(F.broadcast(some), F.col("id") == F.col("lid")).groupBy("lid", "y").agg(F.min("x").alias("x")).select("x", "y")


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label_col: str = "quality", each: int = 3000) -> DataFrame:
    """One row per document: ``id``, ``evidence``, ``host_posterior``, ``path_posterior``, ``score``, ``kept``.

    The classifier is fitted on a sample of ``each`` labelled rows a class at
    most (the documented bound). Its probability of every document is summed by
    path, host and in all; a path's mean is shrunk toward its host's and that
    toward the global one, by as many documents as the variances call for. A
    document's own probability is left out of what its site tells. The score
    adds the site's log-odds, beside the global ones, to the document's.
    Null hosts and paths are values of their own; null and empty texts have the
    features of no words; whole texts are read, however long. A score of just
    0.5 is kept. Repeated rows stay, each a document of its site; other columns
    are not read, so their names don't matter. No rows: none.
    """
    rows = cut(docs.select(F.col("doc_id").alias("id"), host.alias("host"), path.alias("path"), features_udf(octets("text")).alias("x")))
    got = training_rows(rows, labels, label_col, each).toPandas()  # a few numbers a row
    w, b = fit(np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy(dtype=float))
    z = F.lit(b)
    for i, wi in enumerate(w):
        z = z + F.col("x")[i] * float(wi)
    p = cut(rows.select("id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))))).alias("p")))
    paths = cut(p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"), F.count("*").alias("parts")))
    all_ = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k")).first()
    n, s = all_["n"] or 1, all_["s"] or 0.5
    mean = s / n
    by_host = hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s"), F.col("hss").alias("ss"), F.lit(n).alias("pn"), F.lit(s).alias("ps"), F.lit(all_["k"] or 1).alias("parts"))
    k_host = _strength(by_host)
    site = paths.alias("a").join(small(hosts.withColumnRenamed("host", "of"), BROADCAST_SITES), F.col("host").eqNullSafe(F.col("of")))
    site = site.select("host", "path", "n", "s", "ss", "hn", "hs", "parts")
    k_path = _strength(site.select("n", "s", "ss", F.col("hn").alias("pn"), F.col("hs").alias("ps"), "parts"))
    site = cut(site.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs"))
    met = p.join(small(site, BROADCAST_SITES), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_mean = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    path_mean = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    out = met.withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean)
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    out = out.select("id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5)


def of_url(url: Column) -> tuple[Column, Column]:
    """Host, and first path segment, of a web address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` by source as the host and language as the path beneath it."""
    return posteriors(docs, labels, F.col("source"), F.col("lang")).withColumnRenamed("id", "doc_id")
