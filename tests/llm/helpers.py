"""Small tables with the cases that every operator must bear."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names operators use inside.
CLASHES = "id fp size hash score predicted kept x y hits found root component row bucket target taken spans key k of n".split()

PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all of the hounds in the wood"


def docs(spark, rows, clash=False):
    """Documents of (doc_id, text, source) or (doc_id, text)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(-1).alias(c) for c in CLASHES))
    return df


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and repeated ids."""
    return [
        (1, PROSE), (1, PROSE), (2, PROSE), (2, "another text under the same id"), (None, PROSE), (None, None), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "),
        (6, (PROSE + "\n") * 20_000), (7, "x"), (8, "é" * 50_000), (9, "a b c\u0085d"), (10, "\x00\x01\x02"), (11, PROSE, None),
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
