"""Functions of arrays that Spark lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def running_sums(numbers: Column) -> Column:
    """The sum of all elements up to each one of an array of integers; null for null. Only the numbers leave the JVM."""

    @F.pandas_udf("array<int>")
    def of(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else np.cumsum(np.asarray(a, np.int64)).tolist() for a in arrays], dtype=object)

    return of(numbers)


MATCHES = "array<struct<start:int,whole:string,found:string>>"


def placed(gaps: Column, whole: Column, found: Column | None = None) -> Column:
    """Matches with their places: array of struct(start, whole, found), from the lengths of the gaps around matches (one more than these); null for null.

    ``found`` is a group of each match, by default the whole of it.
    """

    def rows(g, w, f) -> list[dict]:
        out, at = [], 0
        for gap, match, part in zip(g, w, f):
            at += int(gap)
            out.append({"start": at, "whole": match, "found": part})
            at += len(match)
        return out

    if found is None:

        @F.pandas_udf(MATCHES)
        def of(gaps: pd.Series, whole: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else rows(g, w, w) for g, w in zip(gaps, whole, strict=True)], dtype=object)

        return of(gaps, whole)

    @F.pandas_udf(MATCHES)
    def of_parts(gaps: pd.Series, whole: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else rows(g, w, f) for g, w, f in zip(gaps, whole, found, strict=True)], dtype=object)

    return of_parts(gaps, whole, found)
