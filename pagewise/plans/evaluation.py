"""The evaluation pipeline: prompts, predictions and scores as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics, text
from ..operators.scoring import few


def prompts(examples: DataFrame, templates: DataFrame, most_tokens: int, family: str = "") -> DataFrame:
    """``examples`` with ``prompt``: template of the dataset filled in, cut in the middle, in the family's turn format.

    ``templates`` (``dataset``, ``template``) is broadcast if a bounded count shows that it is small.
    Tokens are whitespace-delimited. Tasks that answer better without turns get none;
    a dataset without a template has a null prompt.
    """
    met = examples.join(few(templates, 1000), "dataset", "left")
    filled = text.fill_template(F.col("template"), F.col("context"), F.col("input"))
    words = F.split(filled, " ")
    cut = F.when(F.size(words) > most_tokens, F.array_join(text.truncate_middle(words, most_tokens), " ")).otherwise(filled)
    wrapped = F.when(F.col("dataset").isin(*metrics.PLAIN_PROMPT_TASKS), cut).otherwise(text.chat_prompt(cut, family))
    return met.withColumn("prompt", wrapped).drop("template")


def remaining(examples: DataFrame, done: DataFrame, key: str = "_id") -> DataFrame:
    """Examples that have no prediction yet, in any order of either."""
    return examples.join(done.select(key), key, "left_anti")


def row_scores(predictions: DataFrame) -> DataFrame:
    """``predictions`` (``dataset``, ``pred``, ``answers``, ``all_classes``) with ``score``: the best over answers.

    Rows are read once, each scored by its dataset's metric; 0 without answers,
    null for a dataset that has no metric. No shuffle.
    """
    line = F.when(F.col("dataset").isin(*metrics.FIRST_LINE_TASKS), text.first_line(F.col("pred"))).otherwise(F.col("pred"))
    return predictions.withColumn("score", best_score(F.col("dataset"), line, F.col("answers"), F.col("all_classes")))


def best_score(dataset: Column, pred: Column, answers: Column, classes: Column) -> Column:
    """The greatest score of a prediction over an array of answers, by the dataset's metric."""

    @F.pandas_udf(T.DoubleType())
    def best(d: pd.Series, p: pd.Series, a: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for name, x, ys, z in zip(d, p, a, c):
            score = metrics.METRICS[metrics.TASKS[name][0]] if name in metrics.TASKS else None
            listed = list(z) if z is not None else []
            out.append(None if score is None else max((score(x or "", y or "", listed) for y in (ys if ys is not None else [])), default=0.0))
        return pd.Series(out, dtype="Float64")

    return best(dataset, pred, answers, classes)


def dataset_scores(scored: DataFrame, by: str = "dataset") -> DataFrame:
    """Mean score in hundredths, rounded to two places."""
    return scored.groupBy(by).agg(F.round(100 * F.avg("score"), 2).alias("score"))


def bucket_of(length: Column) -> Column:
    c = F.lit("8k+")
    for limit, name in reversed(metrics.LENGTH_BUCKETS):
        c = F.when(length < limit, name).otherwise(c)
    return c


def bucket_scores(scored: DataFrame, spark: SparkSession, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean score by length bucket; a bucket without rows is there with NaN."""
    names = spark.createDataFrame([(n,) for _, n in metrics.LENGTH_BUCKETS] + [("8k+",)], "bucket string")
    got = scored.groupBy(*by, bucket_of(F.col("length")).alias("bucket")).agg(F.round(100 * F.avg("score"), 2).alias("score"))
    all_ = scored.select(*by).distinct().join(F.broadcast(names)) if by else names
    return all_.join(got, [*by, "bucket"], "left").withColumn("score", F.coalesce("score", F.lit(float("nan"))))


def same_for_all(df: DataFrame, column: str) -> bool:
    """Whether a column has one value; of no rows it does."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    return r["a"] == r["b"]


def latency(steps: DataFrame, by: str, order: list[str], seconds: Column) -> DataFrame:
    """Of each sequence of time stamps: the first two differences together, and the mean of the others."""
    w = Window.partitionBy(by).orderBy(*order)
    d = steps.select(by, F.row_number().over(w).alias("i"), (seconds - F.lag(seconds).over(w)).alias("d")).where("d IS NOT NULL")
    return d.groupBy(by).agg(F.sum(F.when(F.col("i") <= 3, F.col("d"))).alias("prefill_s"), F.avg(F.when(F.col("i") > 3, F.col("d"))).alias("decode_s"))
