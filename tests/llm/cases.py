"""Small tables for the training-data operators: odd rows, and folders like the given ones."""
import os
import tempfile

import pytest  # noqa: F401
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old green tree near a quiet river bank".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int, key string, spans string"


def _words(n, seed):
    return [f"{BASE[(i * 7 + seed) % len(BASE)]}{(i * i + seed) % 89}" for i in range(n)]


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing column names."""
    plain, near = _words(200, 3), _words(200, 3)
    near[100] = "changed"
    texts = [
        (1, " ".join(plain)), (2, " ".join(near)), (3, " ".join(plain)), (4, None), (5, ""), (6, " \n\t "), (7, LONG),
        (8, "***"), (9, "***"), (None, "short text without id"), (None, None), (10, "a"), (11, "Ünïcödé wörds ñandú " * 40),
        (12, "tab\tand\x0bvertical\x0cfeed\r\nnul\x00inside\x1cfs nbsp   x  y   z"), (13, "line\n" * 60),
        (14, "x" * 5000), (15, " ".join(_words(64, 9))), (15, " ".join(_words(64, 9))), (16, "THE IDIOT!! " * 30),
        (17, "don't we'll <|endoftext|> it's 12,345.67 　 end "),
    ]
    rows = [(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", None if t is None else len(t), "old", 1, "k", None)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def folder(spark, docs, benchmark=None, labels=None, pages=None):
    """A data folder with these tables; tables not given are empty."""
    path = tempfile.mkdtemp(prefix="abode-llm-case-")
    tables = {
        "documents": docs,
        "benchmark": benchmark if benchmark is not None else spark.createDataFrame([], "item_id long, text string"),
        "labels": labels if labels is not None else spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
        "pages": pages if pages is not None else spark.createDataFrame([], "page_id long, url string, html string"),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, f"{name}.parquet"))
    return path


def rows_of(df):
    return [r if isinstance(r, Row) else r for r in df.collect()]
