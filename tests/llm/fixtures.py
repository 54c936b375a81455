"""Odd documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, h long, words long"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, 2)


ODD = [
    row(1, None), row(2, ""), row(3, " \n\t"), row(4, "one two three"), row(4, "one two three"), row(None, "no id here"),
    row(5, "a b c " * 20_000), row(6, "no source", None, None), row(7, "Ünïcode wörds and more", "de", "é"), row(8, "x"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sf(name, scale="sf0.001"):
    return f"/root/testdata/{scale}/{name}.parquet"
