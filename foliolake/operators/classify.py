"""Line types from any model: probabilities by a batch function, then what must hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import doc


def probabilities(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], columns: list[str], name: str = "p") -> DataFrame:
    """Adds an array of class probabilities: model takes a matrix of the columns, nulls as
    0, and gives a row of probabilities for each. Batches come over Arrow."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield pd.Series(list(model(frame.fillna(0).to_numpy(float))), index=frame.index)

    made = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn(name, made(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def best(p: str, classes: tuple[str, ...]) -> Column:
    """The class of the greatest probability, the first one of equals."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(p, F.array_max(p)).cast("int"))


def settled(rows: DataFrame, classes: tuple[str, ...], title: str = "title", body: tuple[str, ...] = (), p: str = "p") -> DataFrame:
    """line_type from probabilities: blank lines are raw text; from the first line of a body
    class on no line is a title, whose probability counts as 0 there."""
    first = F.min(F.when(best(p, classes).isin(*body) & (F.trim("text") != ""), F.col("line_id"))).over(doc())
    rows = rows.withColumn("__first", first)
    k = classes.index(title)
    later = F.transform(p, lambda x, i: F.when(i == k, 0.0).otherwise(x))
    rows = rows.withColumn(p, F.when(F.col("line_id") >= F.col("__first"), later).otherwise(F.col(p)))
    return rows.withColumn("line_type", F.when(F.trim("text") == "", "raw_text").otherwise(best(p, classes))).drop("__first")
