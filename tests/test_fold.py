"""Folding (M1) and case folding (M2 keys)."""

import unicodedata

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shroud.functions.fold import casefold, fold, python_fold


def nfkd_strip(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_documents_equal_nfkd(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "text", fold(F.col("text")).alias("f"), casefold(fold(F.col("text"))).alias("k")).collect()
    for r in rows:
        assert r.f == nfkd_strip(r.text)
        assert r.k == nfkd_strip(r.text).casefold()


def test_cases(spark):
    cases = {
        "José met Jose": ("Jose met Jose", "jose met jose"),
        "STRASSE straße": ("STRASSE straße", "strasse strasse"),
        "ΟΔΟΣ": ("ΟΔΟΣ", "οδοσ"),
        "José": ("Jose", "jose"),
        "ﬁ Jose": ("ﬁ Jose", "fi jose"),  # multi-character folds keep offsets: left as is
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", fold(F.col("t")).alias("f"), casefold(fold(F.col("t"))).alias("k")).collect():
        assert (r.f, r.k) == cases[r.t]
        assert python_fold(r.t) == r.f
