"""Small tables with the awkward cases every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # Names that operators might use inside.
    + [T.StructField(c, T.StringType()) for c in ("fingerprint", "__id", "__row", "group", "row", "spans", "label", "score")]
    + [T.StructField("n_chars", T.LongType())]
)
LONG = "lorem ipsum dolor sit amet consectetur " * 3000 + "password = hunter2hunter2"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b"), (5, "a b"), (6, "one"), (None, "x y z w"), (None, None),
    (7, "Ünïcode ſharp 中文字 😀 x y z"), (8, "tie"), (8, "knot"), (9, "A B"),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, *["x"] * 8, len(t or "")) for i, t in rows], SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
