"""Text functions.  Built-in expressions where Spark's semantics are right, Arrow-batched Python where they are not."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which lower() is not."""
    return s.map(str.casefold, na_action="ignore")


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Normal form C; ASCII stays in the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfc(c))


@pandas_udf(StringType())
def _repr(s: pd.Series) -> pd.Series:
    return s.map(repr, na_action="ignore")


def py_repr(c: Column) -> Column:
    """A string quoted as in messages: plain printable ASCII in the JVM, the rest in Python."""
    return F.when(c.rlike(r"^[\x20-\x26\x28-\x5B\x5D-\x7E]*$"), F.concat(F.lit("'"), c, F.lit("'"))).when(c.isNull(), F.lit("None")).otherwise(_repr(c))



def clean_href(c: Column) -> Column:
    """A relative path with forward slashes, or null for remote, absolute and drive paths."""
    away = c.contains("://") | c.rlike(r"^(https?:|file:)") | c.rlike(r"^[/\\]") | c.rlike(r"^[A-Za-z]:")
    slashed = F.regexp_replace(c, r"\\", "/")
    return F.when(~away, F.regexp_replace(F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), r"/(\./)+", "/"), r"^(\./)+", ""))
