"""Small tables with awkward rows, and reads of the given ones."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string, key string, data string, at string, _bucket string"


def frame(spark, rows):
    """Documents of (doc_id, text[, source]) with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "n", "k", "d", "a", "b") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def given(spark, folder, name="documents"):
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df, [r.asDict() for r in df.collect()]


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
