"""Where users add their own parts: patterns, readers, table functions, aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .operators import patterns
from .sources import readers

#: name -> a pattern made of its parameters
PATTERNS: dict[str, Callable[..., patterns.Pattern]] = {}


def pattern(name: str) -> Callable:
    """Register a maker of patterns for the name that a list of patterns uses."""

    def add(make: Callable[..., patterns.Pattern]) -> Callable[..., patterns.Pattern]:
        PATTERNS[name] = make
        patterns.MAKERS[name] = make
        return make

    return add


def reader(*endings: str) -> Callable:
    """Register a reader (name, content) -> lines for file endings."""

    def add(read: Callable[[str, bytes], list[tuple]]) -> Callable:
        readers.ITEM_READERS.update(dict.fromkeys(endings, read))
        return read

    return add


class SplitLines:
    """A table function: text and separator -> its pieces with their places."""

    def eval(self, text: str, sep: str):
        for i, piece in enumerate((text or "").split(sep)):
            yield i, piece


def deviation(values: pd.Series) -> float:
    """An aggregate: the median distance from the median."""
    return float((values - values.median()).abs().median())


def register(spark: SparkSession) -> None:
    """Make split_lines (a table function) and deviation (an aggregate) known to SQL."""
    spark.udtf.register("split_lines", F.udtf(SplitLines, returnType="line_id int, text string"))
    spark.udf.register("deviation", aggregate())


def aggregate() -> Callable[[Column], Column]:
    return F.pandas_udf(deviation, "double")
