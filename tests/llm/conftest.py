import pytest


@pytest.fixture()
def docs(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash with inner names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 7, 8) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, node long, label long")

    return make
