import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (doc_id, text[, source]) rows, with columns whose names operators use inside."""

    def make(rows, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("fp", "k", "h", "d", "t", "s", "src", "place", "epoch", "component_id", "kept_id", "tid", "toxic", "score", "anchor", "id"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
