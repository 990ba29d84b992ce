"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than these six; ``bytes.split()`` cuts at the same ones.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local one is set if master is local (one
    machine, as in tests); on a cluster that would lose data, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` by way of reliable storage: what follows neither repeats
    nor depends on what came before, so a lost executor costs one read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder, which ``drop`` deletes once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, new_dir(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: lineage ends, and its size is known to the planner."""
        path, self.n = f"{self.at}/{self.n}", self.n + 1
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        got._pw_path = path
        return got

    def free(self, *tables: DataFrame) -> None:
        """Tables that ``keep`` gave and that nothing reads any more."""
        for t in tables:
            delete(self.spark, t._pw_path)

    def drop(self) -> None:
        delete(self.spark, self.at)


def delete(spark: SparkSession, path: str) -> None:
    """The folder goes, by way of the file system that Spark uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def salted(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined to ``table`` (one row per ``on``), rows of one key dealt over ``salts`` tasks by ``by``.

    Each row of the table is repeated ``salts`` times, so a key that most rows share is no task's alone.
    """
    rows = rows.withColumn("__pw_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    table = table.withColumn("__pw_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(table, [on, "__pw_salt"], how).drop("__pw_salt")


def octets(column: str | Column) -> Column:
    """UTF-8 of a text column (null: empty), which Python workers take without decoding."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


#: Names of a row's key.
ROW = ["__pw_row", "__pw_row2"]


def row_key(columns: list[str], schema: T.StructType) -> list[Column]:
    """Two longs that tell rows apart by all their columns; maps are compared by their sorted entries."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind)
        return not isinstance(kind, (T.MapType, T.VariantType))

    def value(c: str) -> Column:
        kind, x = schema[c].dataType, F.col(f"`{c}`")
        if plain(kind):
            return x
        if isinstance(kind, T.MapType) and plain(kind.keyType) and plain(kind.valueType):
            return F.array_sort(F.map_entries(x))
        return F.to_json(F.struct(x.alias("x")))

    values = [value(c) for c in columns]
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in ((1, "__pw_row"), (2, "__pw_row2"))]


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its row count is within the bound, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["ROW", "SPACE", "Scratch", "cut", "delete", "fits", "new_dir", "octets", "read", "row_key", "salted", "shared_dir", "small"]
