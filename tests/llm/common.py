"""Small tables with the awkward cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def awkward():
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 10),
        (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "en", "b", 4),
        (5, long, "en", "b", len(long)), (6, long, "en", "c", len(long)),
        (7, "same text here again and again", "fr", "c", 3), (7, "same text here again and again", "fr", "c", 3),
        (None, "a row without id has words too", "en", None, 3), (8, "é ü ñ – 漢字 😀 text", "de", "", 3),
    ]


def prose(n, seed=1, words=400, length=(5, 80)):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(words)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(*length))) for _ in range(n)]


def clash(df, *names):
    """The same rows with further columns that are named like an operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
