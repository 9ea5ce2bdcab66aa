import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **columns):
        """Documents of a dict id -> text; other columns by keyword, constants or dicts by id."""
        pick = lambda name, i, default: (columns[name].get(i) if isinstance(columns[name], dict) else columns[name]) if name in columns else default
        items = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, pick("lang", i, "en"), pick("source", i, "s"), len(t) if t is not None else None) for i, t in items]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def with_clashes():
    def add(df):
        """Extra columns named like the operators' own."""
        return df.withColumns({c: F.lit("mine") for c in ("row", "out", "id", "key", "size", "block", "n", "n_words", "score", "kept", "spans", "token", "component", "rep", "copies", "h", "copy", "shard", "order_key", "kept_id", "page", "uid", "stream", "matches")})

    return add
