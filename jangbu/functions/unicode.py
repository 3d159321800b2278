"""Unicode forms, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in s], dtype=object)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in s], dtype=object)
