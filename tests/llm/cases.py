"""Documents with the awkward cases: nulls, empties, ties, repeats, long texts, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", None if i % 5 == 4 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS size", "'x' AS key", "0 AS start") if extra else df


def saved(spark, tmp_path, texts, **tables):
    """A folder of tables for a registered query."""
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows_of(df):
    return {r[0]: r for r in df.collect()}
