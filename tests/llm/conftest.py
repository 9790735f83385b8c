import pytest

DOC_TYPES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text[, lang]); with columns named like outputs."""
    def build(*items, extra=False):
        rows = []
        for i, item in enumerate(items):
            key, text, lang = (*item, "en")[:3] if isinstance(item, tuple) else (i, item, "en")
            rows.append((key, text, lang, "s", None if text is None else len(text)))
        df = spark.createDataFrame(rows, DOC_TYPES)
        if extra:
            for name in ("fingerprint", "component_id", "digest", "kept", "keep_id", "spans", "score", "length", "piece",
                         "word", "k", "n", "_text", "id", "row"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return build
