"""Mixing by iterative proportional fitting, then sampling by calibrated probabilities.

Cells are the combinations of source, language and topic; a cell's mass is its tokens
(words). Raking scales the cells until each marginal has its target share. Every document
of a cell is kept with probability min(1, scale x target mass / mass), the scale chosen so
that the expected tokens meet the wanted share; the draw is a hash of the id, so it is
the same on every run and every machine.

Raking ends when every marginal is met to TOLERANCE, after ROUNDS rounds at most; targets
that no scaling can meet (a wanted category without mass, cells that rule each other out)
are told in a warning with the largest miss.

Cases: null source, language or topic are a category of their own; a null text has no
words (its documents count nothing to the mass and are drawn as others of the cell);
repeated rows of one id are drawn alike; an empty table gives an empty result; extra
columns stay, helper columns carry a prefix."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

DIMS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 200, 1e-13
#: Beyond this many cells the raking runs on the cluster, a table a round.
DRIVER_CELLS = 200_000
P = "__w_"


def n_words(text: str = "text") -> Column:
    trimmed = F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM coalesce({text}, ''))")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def topic(text: str, words: Column) -> Column:
    """The default topic is the genre by shape: tables, pieces, articles or long works.
    Any other column or classifier may take its place."""
    return F.when(F.coalesce(F.col(text), F.lit("")).contains(" | "), "table").when(words < 100, "piece").when(words < 1000, "article").otherwise("long")


def uniform(id_col: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_col.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def tempered(mass: dict, power: float) -> dict:
    """Shares in proportion to a power of the present ones."""
    total = sum(v**power for v in mass.values() if v > 0)
    return {k: (v**power / total if v > 0 else 0.0) for k, v in mass.items()}


def rake(cells: list[tuple], mass: np.ndarray, targets: list[dict], rounds: int = ROUNDS) -> np.ndarray:
    """The cells' masses, scaled to the targets' shares one dimension after the other."""
    if not mass.sum():
        return mass
    w = mass / mass.sum()
    dims = []
    for d, target in enumerate(targets):
        names = sorted({c[d] for c in cells}, key=str)
        at = {k: i for i, k in enumerate(names)}
        dims.append((np.array([at[c[d]] for c in cells]), np.array([target.get(k, 0.0) for k in names])))
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for of, want in dims:
            have = np.bincount(of, w, len(want))
            off = max(off, float(np.abs(have - want).max()))
            w = w * np.divide(want, have, out=np.zeros(len(want)), where=have > 0)[of]
        if off < TOLERANCE:
            break
    _told(off)
    return w


def _told(off: float) -> None:
    if off > 1e-6:
        warnings.warn(f"raking left marginals off by up to {off:.2g} before its last round", stacklevel=3)


def _rake_cluster(cells: DataFrame, power: float, rounds: int, targets: dict[str, dict] | None = None) -> DataFrame:
    """The same for very many cells; marginals are sums with map-side combining."""
    df = cells.withColumn("w", F.col("mass").cast("double"))
    wants: dict[str, DataFrame] = {}
    for d in DIMS:
        if given := (targets or {}).get(d):
            wants[d] = keep(cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "k string, want double"), "want")
            continue
        m = cells.groupBy(d).agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("p"))
        total = m.agg(F.sum("p")).first()[0]
        wants[d] = keep(m.select(F.col(d).alias("k"), (F.col("p") / F.lit(total)).alias("want")), "want")
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for d in DIMS:
            have = df.groupBy(F.col(d).alias("of")).agg(F.sum("w").alias("have"))
            have = keep(have.join(wants[d], F.col("of").eqNullSafe(F.col("k"))).drop("of"), "have")
            off = max(off, have.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            df = df.join(have, F.col(d).eqNullSafe(F.col("k")), "left").withColumn("w", F.coalesce(F.col("w") * F.try_divide("want", "have"), F.lit(0.0))).drop("k", "have", "want")
        df = keep(df, "raked")
        if off < TOLERANCE:
            break
    _told(off)
    return df


def probabilities(docs: DataFrame, power: float = 0.5, share: float = 0.7, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, text: str = "text", topic_col: Column | None = None) -> DataFrame:
    """docs with n_words, topic, u and p, under prefixed names; see sample()."""
    spark = docs.sparkSession
    df = docs.withColumn(P + "words", n_words(text))
    df = df.withColumn(P + "topic", topic_col if topic_col is not None else topic(text, F.col(P + "words")))
    cells = keep(df.groupBy(F.col("source"), F.col("lang"), F.col(P + "topic").alias("topic")).agg(F.sum(P + "words").alias("mass")), "cells")
    if cells.count() <= DRIVER_CELLS:
        rows = sorted((tuple(r[d] for d in DIMS) + (r["mass"],) for r in cells.collect()), key=str)
        names, mass = [r[:3] for r in rows], np.array([float(r[3]) for r in rows])
        wants = []
        for d, dim in enumerate(DIMS):
            have: dict = {}
            for c, m in zip(names, mass, strict=True):
                have[c[d]] = have.get(c[d], 0.0) + m
            wants.append((targets or {}).get(dim) or tempered(have, power))
        w = rake(names, mass, wants, rounds)
        schema = "source string, lang string, topic string, mass double, w double"
        raked = spark.createDataFrame([(*c, float(m), float(x)) for c, m, x in zip(names, mass, w, strict=True)], schema)
    else:
        raked = _rake_cluster(cells, power, rounds, targets)
    raked = keep(raked.withColumn("r", F.coalesce(F.try_divide("w", F.col("mass")), F.lit(0.0))), "raked")
    scale = _scale(raked, share)
    prob = raked.select(*[F.col(d).alias(P + "c_" + d) for d in DIMS], F.least(F.lit(1.0), F.col("r") * scale).alias(P + "p"))
    on = F.col("source").eqNullSafe(F.col(P + "c_source")) & F.col("lang").eqNullSafe(F.col(P + "c_lang")) & F.col(P + "topic").eqNullSafe(F.col(P + "c_topic"))
    small = raked.count() <= DRIVER_CELLS
    return df.join(F.broadcast(prob) if small else prob, on, "inner").withColumn(P + "u", uniform(F.col("doc_id"))).drop(*[P + "c_" + d for d in DIMS])


def _scale(raked: DataFrame, share: float) -> float:
    """s with sum(mass x min(1, s x r)) = share x sum(mass), by halving in log s; a sum
    over the cells a step."""
    total, top = raked.agg(F.sum("mass"), F.max("r")).first()
    if not total or not top:
        return 0.0
    low, high = 0.0, 60.0  # log2 of s x top
    steps = [low + (high - low) * i / 64 for i in range(65)]
    for _ in range(6):
        got = raked.agg(*[F.sum(F.col("mass") * F.least(F.lit(1.0), F.col("r") * (2.0**x / top))) for x in steps]).first()
        over = next((i for i, g in enumerate(got) if g >= share * total), len(steps) - 1)
        if over == 0:
            return 2.0 ** steps[0] / top * min(1.0, share * total / got[0])
        low, high = steps[over - 1], steps[over]
        steps = [low + (high - low) * i / 64 for i in range(65)]
    return 2.0**high / top


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents, with their columns."""
    return probabilities(docs, **options).where(f"{P}u < {P}p").drop(*[P + x for x in ("words", "topic", "p", "u")])
