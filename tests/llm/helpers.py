"""Small tables that every operator must stand: nulls, empty and long texts, ties, repeats, odd columns."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, root string, n string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))


def odd_rows():
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text), (1, text), (2, text), (2, "another text under the same id, of other words entirely"), (None, text), (None, None),
        (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "a"), (8, "é ñ ß 中文 \U0001f600 mail me: a.b@c.de"), (9, "\n\n\n"),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "src1", None, 0.5, "k", "r", "n") for i, t in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score double")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))


def thue_morse(n):
    """Two words of n characters whose polynomial hashes modulo 2**64 are equal whatever the base."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
