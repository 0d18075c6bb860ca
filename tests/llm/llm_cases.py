"""Rows that every operator must take."""
LONG = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, key string, bucket int, chunk int, row int"


def docs(spark, rows):
    """``rows``: (doc_id, text), with columns whose names are in use inside operators."""
    full = [(i, t, "en", "s", 1, "x", "y", "k", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGE = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, LONG), (5, LONG), (6, "tie tie tie"), (6, "tie tie tie"),
        (None, "a row without id has words too"), (7, "é ß 日本 🙂 \u0085  x"), (8, "x" * 100_000)]
