"""Small hand-made tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(words: int = 6000) -> str:
    return " ".join(f"wort{i % 701} der{i % 13}" for i in range(words // 2))


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "web", 60),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "web", 60),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "web", 60),
    (3, None, None, None, None),
    (4, "", "de", None, 0),
    (5, " \n\t ", "de", "news", 4),
    (6, "12345 67890 !!", "de", "news", 14),
    (7, "der die das und ist ein haus am see mit garten", "de", "news", 47),
    (8, long_text(), "de", "web", None),
    (9, "été à la plage avec des amis 𝒳 ça va", "fr", "", 36),
    (None, "a row without an id but with words of its own in it", "en", "web", None),
    (10, "word", None, "web", 4),
]


def edge_docs(spark, rows=ROWS):
    """The edge rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("shard", "slot", "size", "score", "lang_pred", "component_id", "kept", "key", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
