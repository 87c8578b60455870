import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents from texts; ids run from 0 unless given as pairs."""

    def make(texts, lang="en"):
        rows = [(*t, lang, "src0", len(t[1] or "")) if isinstance(t, tuple) else (i, t, lang, "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Nulls, blanks, marks, other scripts, special strings, repeats, and a long text without and one with spaces.
ODD = [None, "", " ", "\n\n\t", "a", "it's we'll  I'd", "x" * 3000, "word " * 2500, "漢字 かな 🙂 é́", "a<|endoftext|>b <|endoftext|>", "tab\tand\x0bmore\x0c end\x85x y", "1234 56.7 §$%&", "same text", "same text", "꟎ŀא 1²½ ⅷ"]
