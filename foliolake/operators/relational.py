"""Joins by ranges and times, and a global order, dealt so that no key takes all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def near_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left with the rows of right of the same keys whose place `at` (a whole number)
    is `width` away at most. The right side's columns carry the prefix r_. Places are dealt to
    buckets of that width and each right row to three of them, so the join is on equal keys
    and grows with the rows that are near, not with all of a key's."""
    a = left.withColumn("__bucket", F.floor(F.col(at) / width))
    b = right.select(*keys, *[F.col(c).alias("r_" + c) for c in right.columns if c not in keys])
    home = F.floor(F.col("r_" + at) / width)
    b = b.withColumn("__bucket", F.explode(F.array(home - 1, home, home + 1)))
    inside = F.abs(F.col(at) - F.col("r_" + at)) <= width
    found = a.join(b, [*keys, "__bucket"]).where(inside).drop("__bucket")
    if how == "inner":
        return found
    missing = left.join(found.select(*keys, at).distinct(), [*keys, at], "left_anti")
    for c in b.columns:
        if c.startswith("r_"):
            missing = missing.withColumn(c, F.lit(None).cast(found.schema[c].dataType))
    return found.unionByName(missing)


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, seconds: int) -> DataFrame:
    """Points with the spans [start, end] of the same keys that hold them. Spans are dealt to
    the buckets of `seconds` that they touch, points to one; times may be on a stream's
    side with watermarks as well."""
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    p = points.withColumn("__bucket", bucket(at))
    s = spans.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, [*keys, "__bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def global_order(rows: DataFrame, by: str, ties: list[str], name: str = "rank", parts: int = 64) -> DataFrame:
    """Rows numbered from 0 in the order of a number (descending), then of other columns.
    Quantiles of the number cut the rows into parts that are sorted side by side; a part
    begins where the counts of those before it end, so no task sees all rows."""
    cuts = sorted(set(rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.01)), reverse=True)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(by) < c)) if cuts else F.lit(0)
    dealt = rows.withColumn("__part", part)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # as many rows as parts
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(by), *ties)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("before") + F.col("__own")).cast("long")).drop("__part", "__own", "before")


def near_exact(approximate: Column, exact: Column, share: float) -> Column:
    """Whether an approximate aggregate lies within a share of the exact one."""
    return F.abs(approximate - exact) <= share * F.abs(exact)
