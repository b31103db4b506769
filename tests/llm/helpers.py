"""A messy table for every operator: nulls, empty, blank and long texts, repeated rows, clashing names."""

LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs home again.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog and then it runs home again.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog and then it runs home again.", "en", "a", 70),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "b", 4),
    (None, "no id here but some words that nobody else has", "en", "b", 46),
    (None, None, None, None, None),
    (6, LONG, "en", "b", len(LONG)),
    (7, "two words", "de", "b", 9),
    (8, "Two Words", "de", "b", -5),
    (9, "ünï ▁ cödé 漢字 \U0001f600 <0x0A>\r\n\n\ttab", "xx", "c", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ["key", "score", "pii", "pieces", "decoded", "label", "shard", "slot", "component", "component_id", "text_hash", "_text", "_row", "line", "line_no", "kept", "word", "c", "a", "b", "row", "x", "id", "level", "_score", "terms", "item_id"]


def messy(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASH:
        df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
