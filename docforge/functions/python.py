"""The few scalar forms that the JVM's functions can't express, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp ratio of two texts, without the popularity rule (X19); 0 if one is empty, null for null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        one = lambda p, q: None if p is None or q is None else SequenceMatcher(None, p, q, autojunk=False).ratio() if p and q else 0.0
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def nfkc(c: str) -> Column:
    """Unicode NFKC form, soft hyphens dropped."""

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v.replace("\u00ad", "")))

    return form(c)


def folded(c: str) -> Column:
    """Case-folded text without combining marks."""

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        bare = lambda v: "".join(k for k in unicodedata.normalize("NFKD", v) if not unicodedata.combining(k)).casefold()
        return x.map(lambda v: None if v is None else bare(v))

    return form(c)
