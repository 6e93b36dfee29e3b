"""Rows that every operator must survive."""

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (None, "a text without an id, of some words"),
    (5, "word " * 30000),
    (6, "x" * 100000),
    (7, "MiXed Case é ß 漢字 　 \x00 end\r\nnext line\n\nlast"),
    (8, "<|endoftext|> <s> </s> ▁ ▁▁a  b"),
]


def frame(spark, rows=ODD):
    """doc_id, text and columns whose names clash with results."""
    data = [(i, t, "src", "en", -1, "x", True, 0.5) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_words long, items string, kept boolean, score double")


def empty(spark):
    return frame(spark, [(1, "a")]).limit(0)
