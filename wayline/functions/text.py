"""Match keys and cleaned text. Python runs on a vocabulary's non-ASCII values only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    """NFKC, then without combining marks."""
    return values.map(lambda v: v if v is None else "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", v)) if not unicodedata.combining(c)))


def fold(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the value with accents folded; ASCII values do not leave the JVM."""
    plain = F.coalesce(~F.col(value).rlike("[^\\x00-\\x7f]"), F.lit(True))
    ascii_ = df.filter(plain).withColumn(name, F.col(value))
    return ascii_.unionByName(df.filter(~plain).withColumn(name, _folded(value)))


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def compose(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the value in normal form NFKC; ASCII values, which it does not change, do not leave the JVM."""
    plain = F.coalesce(~F.col(value).rlike("[^\\x00-\\x7f]"), F.lit(True))
    return df.filter(plain).withColumn(name, F.col(value)).unionByName(df.filter(~plain).withColumn(name, _composed(value)))


def match_key(folded: Column) -> Column:
    """Lower case, & as "and", letters, digits, + and # kept, all else one space."""
    text = F.regexp_replace(F.lower(folded), "&", " and ")
    return F.trim(F.regexp_replace(text, "[^a-z0-9+#]+", " "))


def token_key(key: Column) -> Column:
    """Its distinct words in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))), " ")


def clean_text(text: Column) -> Column:
    """Control characters and white space runs as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", " "), "\\s+", " ")), F.lit(""))


def clean_values(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``clean_text`` of the value in normal form NFKC, with straight quotes."""
    straight = F.translate(F.col(name), "\u2018\u2019\u00a0", "'' ")
    return compose(df, value, name).withColumn(name, clean_text(straight))


def soundex_block(key: Column) -> Column:
    """Word count and the sorted phonetic codes of the words."""
    words = F.filter(F.split(key, " "), lambda t: t != "")
    return F.concat_ws("|", F.size(words), F.array_join(F.array_sort(F.transform(words, lambda w: F.soundex(w))), " "))


def truncate_code(code: Column, level: int) -> Column:
    """The first levels of a dotted code, null if it has fewer."""
    parts = F.split(code, "\\.")
    return F.when(F.size(parts) >= level, F.array_join(F.slice(parts, 1, level), "."))


def tagged(identifier: Column) -> Column:
    """``kind`` and ``value`` of an id like ``raw:acme``."""
    return F.struct(F.split_part(identifier, F.lit(":"), F.lit(1)).alias("kind"), F.regexp_replace(identifier, "^[^:]*:", "").alias("value"))
