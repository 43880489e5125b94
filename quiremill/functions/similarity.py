"""Matching of titles and authors."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; not symmetric: a is the input, b the candidate."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """The ratio can't be larger than this; cheap enough to ask first."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def is_title_part(a: Column, b: Column) -> Column:
    """The input, of 5 characters at least, is part of the title."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (F.length(x) >= 5) & y.contains(x)


def part_confidence(a: Column, title: Column) -> Column:
    """Length ratio, more for a beginning and for a long part, 1 at most."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(title))
    share = F.length(x) / F.length(y)
    return F.least(share + F.when(F.startswith(y, x), 0.1).otherwise(0.0) + F.least(share * 0.2, F.lit(0.2)), F.lit(1.0))


def name_tokens(name: Column, case_sensitive: bool = False) -> Column:
    n = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s.-]", " "), r"(?U)\s+", " "))
    n = n if case_sensitive else F.lower(n)
    return F.filter(F.transform(F.split(n, " "), lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", "")), lambda t: t != "")


def is_token_subset(query: Column, author: Column) -> Column:
    return (F.size(query) > 0) & (F.size(author) > 0) & (F.size(F.array_except(query, author)) == 0)


@F.pandas_udf(T.DoubleType())
def author_similarity(asked: pd.Series, found: pd.Series) -> pd.Series:
    """Mean of the best ratios above 0.7 of the asked authors, plus a fifth of the share that has one, 1 at most."""

    def one(a, b) -> float:
        if a is None or b is None or not len(a) or not len(b):
            return 0.0
        best = [max(SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio() for y in b) for x in a]
        good = [r for r in best if r > 0.7]
        return min(1.0, sum(good) / len(good) + 0.2 * len(good) / len(a)) if good else 0.0

    return pd.Series([one(a, b) for a, b in zip(asked, found, strict=True)])
