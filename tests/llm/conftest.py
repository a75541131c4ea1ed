import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, w binary, node string, bucket long"
SCHEMAS = {
    "documents": DOC, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int, key string, part int",
    "pages": "page_id long, url string, html string, payload string", "benchmark": "item_id long, text string, starts int",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as a folder of Parquet files; documents are (doc_id, text[, source]) with further columns that clash with inner names."""

    def make(**rows):
        for name, schema in SCHEMAS.items():
            got = rows.get(name, [])
            if name == "documents":
                got = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 7, b"x", "n", 3) for r in got]
            elif name == "embeddings":
                got = [(*r, 1, "k", 2) for r in got]
            elif name in ("pages", "benchmark"):
                got = [(*r, "p" if name == "pages" else 1) for r in got]
            spark.createDataFrame(got, schema).repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
