import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    """documents from (doc_id, text[, lang, source]) tuples, with further columns whose names may clash."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("copy", "copies", "mix_key", "fp", "key", "node", "root", "score", "shard", "slot", "piece", "grp", "spans", "label", "n", "size"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return build


#: Nulls in any column, empty, blank and odd texts, repeated rows, a long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a b c d e"), (5, "x"), (5, "x"), (6, "é ü ñ  double  space\n\nlines"), (7, "word " * 20_000), (8, None, None, None), (9, "a\x00b <|endoftext|> c\r\nd\te"), (10, "one two"), (11, "one two"),
]


@pytest.fixture
def odd():
    return ODD
