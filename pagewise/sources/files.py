"""Datasets, predictions, settings and reports on any file system that Spark reaches."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model


def dataset(spark: SparkSession, path: str, balanced: bool = False) -> DataFrame:
    """A benchmark's examples, from Parquet; the length-balanced variant lies beside it with the suffix _e."""
    return spark.read.schema(model.EXAMPLE).parquet(path + "_e" * balanced)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON lines of a run's folder, single files or folders as Spark writes them, with
    ``dataset`` from the name up to its first dot."""
    rows = spark.read.schema(model.PREDICTION).option("pathGlobFilter", "*.json*").option("recursiveFileLookup", "true").json(folder)
    return rows.withColumn("dataset", F.regexp_extract(F.input_file_name(), r"/([^/.]+)[^/]*(?:/part-[^/]*)?$", 1))


def settings(spark: SparkSession, path: str, value: T.DataType | None = None) -> DataFrame:
    """A JSON object of one level as rows ``key``, ``value``."""
    kind = T.MapType(T.StringType(), value or T.StringType())
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def text(spark: SparkSession, path: str) -> DataFrame:
    """Each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


BLOCKS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("question", "model_answer", "answer")]))


def split_blocks(whole: str) -> list[dict[str, str | None]]:
    """Question, model answer and answer of each block of a report.

    A line begins a part by its head (Q: , A_model:, A:) and others go on with
    it. Within a model answer a line that begins with Question: and what
    follows is left out, up to the next part. A block without both answers is
    dropped unless it is the last.
    """
    heads = (("Q: ", "question"), ("A_model:", "model_answer"), ("A:", "answer"))
    out: list[dict[str, str | None]] = []
    now: dict[str, str | None] = {}
    held: dict[str, str | None] = {"model_answer": None, "answer": None}
    part = ""
    for line in whole.splitlines(keepends=True):
        name = next((n for h, n in heads if line.startswith(h)), None)
        if name == "question":
            if now and held["model_answer"] is not None and held["answer"] is not None:
                out.append(now | held)
            now = {"question": line}
        elif name:
            held[name] = line
        elif part == "model_answer" and line.startswith("Question: "):
            name = "other"
        elif part == "question":
            now["question"] += line
        elif part in held:
            held[part] += line
        elif part != "other":
            raise ValueError("text before the first part of a report")
        part = name or part
    if now:
        out.append(now | held)
    return out


@F.pandas_udf(BLOCKS)
def blocks_udf(whole: pd.Series) -> pd.Series:
    return pd.Series([split_blocks(w or "") for w in whole], dtype=object)


def blocks(texts: DataFrame) -> DataFrame:
    """One row per block of each report text: ``path``, ``block``, ``question``, ``model_answer``, ``answer``."""
    return texts.select("path", F.posexplode(blocks_udf("text")).alias("block", "b")).select("path", "block", "b.*")


# The texts of a pass-key case and the range of keys.
FILLER = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again."
TASK = "There is an important info hidden inside a lot of irrelevant text. Find it and memorize them. I will quiz you about the important information there."
QUESTION = "What is the pass key? The pass key is"
KEYS = 49_999


def passkeys(spark: SparkSession, sizes: list[int], depths: int = 20, seed: int = 0) -> DataFrame:
    """``n_garbage``, ``loc``, ``passkey``, ``prompt``: a key line at each depth of each amount of filler.

    Keys are drawn from 1 to 49999 by hash of the case and ``seed``. The filler
    behind the key starts anew, and the question follows without a line break.
    """
    n = F.col("n_garbage")
    cases = spark.createDataFrame([(s,) for s in sizes], "n_garbage long").join(spark.range(depths).select(F.round(F.col("id") / (depths - 1 or 1), 6).alias("loc"), F.col("id").alias("i")))
    key = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), n, F.col("i")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(KEYS)) + 1
    head = F.floor(n * F.col("loc")).cast("int")
    filler = F.repeat(F.lit(FILLER + " "), F.ceil(n / (len(FILLER) + 1)).cast("int") + 1)
    line = F.concat(F.lit("The pass key is "), key, F.lit(". Remember it. "), key, F.lit(" is the pass key."))
    prompt = F.concat_ws("\n", F.lit(TASK), F.substring(filler, F.lit(1), head), line, F.substring(filler, F.lit(1), n.cast("int") - head))
    return cases.select("n_garbage", "loc", key.alias("passkey"), F.concat(prompt, F.lit(QUESTION)).alias("prompt"))


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(scores: DataFrame, path: str, key: str = "dataset", value: str = "score", most: int = 100_000) -> None:
    """Scores as one JSON object in one text file; the number of datasets is bounded and checked."""
    if scores.limit(most + 1).count() > most:
        raise ValueError(f"a report holds at most {most} scores")
    body = scores.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)


def write_transcript(rows: DataFrame, path: str) -> None:
    """Question, model answer and answer of each row as lines of text."""
    line = F.format_string("Q: %s\nA_model:\n%s\nA:\n%s\n", "question", "generation", "answer")
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def empty_pool(spark: SparkSession) -> DataFrame:
    """A page pool without pages, in the store's schema."""
    return spark.createDataFrame([], model.TOKENS)


