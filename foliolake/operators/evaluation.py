"""Labels and evaluation: confusion, precision and recall, folds, alignment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def errors(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Pairs of label and prediction that differ, with their share of all errors."""
    bad = rows.where(F.col(true) != F.col(pred)).groupBy(true, pred).agg(F.count("*").alias("n"))
    return bad.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def scores(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each label."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("tp")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    return sums.select("label", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"))


def fold(id_col: str, k: int) -> Column:
    """A document's fold, by its id's digest."""
    return (F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("long")


def align(truth: DataFrame, found: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Entries of two lists by key and occurrence: matched, mismatched, missed, added."""
    w = Window.partitionBy(*keys).orderBy(text)
    a, b = (d.select(*keys, F.col(text).alias(n), F.row_number().over(w).alias("occurrence")) for d, n in ((truth, "true_text"), (found, "found_text")))
    state = F.when(F.col("found_text").isNull(), "missed").when(F.col("true_text").isNull(), "added").when(F.col("true_text") == F.col("found_text"), "matched").otherwise("mismatched")
    return a.join(b, [*keys, "occurrence"], "full").withColumn("state", state)


def similarity(a: str, b: str) -> float:
    return round(SequenceMatcher(None, a.lower(), b.lower()).ratio(), 6)


def fuzzy(a: Column, b: Column) -> Column:
    """Similarity of two texts as matching blocks of their characters, case-folded."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


#: Items to a pass over the lines, and classes that characters are counted in.
ITEMS, KINDS = 1000, 64
NONE = -(1 << 62)


def _counts(texts: list[str]) -> np.ndarray:
    """Characters by class; what two texts share by class bounds what they share by character."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % KINDS
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * KINDS + codes, minlength=len(texts) * KINDS).reshape(-1, KINDS)


def common(places: dict[str, int], n: int, text: str) -> int:
    """The longest common subsequence's length, by bits: matching blocks in order are
    common to both texts, so their characters are no more."""
    full = (1 << n) - 1
    v, get = full, places.get
    for m in map(get, text):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def seeded(a: str, b: str) -> int:
    """A bound of the matching blocks' characters where b has 200 or more: the matcher then
    takes no block without a character that is rare in b, so each block lies in the longest
    one around such a character of a."""
    most = len(b) // 100 + 1
    rare = {c for c in set(a).intersection(b) if b.count(c) <= most}
    total, n, m = 0, len(a), len(b)
    for i, c in enumerate(a):
        if c in rare:
            longest, j = 0, b.find(c)
            while j >= 0:
                left = right = 1
                while left <= i and left <= j and a[i - left] == b[j - left]:
                    left += 1
                while i + right < n and j + right < m and a[i + right] == b[j + right]:
                    right += 1
                longest, j = max(longest, left + right - 1), b.find(c, j + 1)
            total += longest
    return min(total, n, m)


def _places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _nearest(items: list[tuple[int, str]], known: dict[int, float], most: int | None):
    """The best line of each item in a task's lines: (ratio, -doc_id, -line_id). Bounds by
    lengths, character counts and common subsequences leave pairs aside that can't reach
    the best one so far, or a ratio that is known to be reached somewhere. With `most`
    only so many lines of a batch are tried for an item."""
    low = [t.lower() for _, t in items]
    counts, places = _counts(low), [_places(t) for t in low]
    sizes = np.array([len(t) for t in low])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(known.get(i, -1.0), NONE, NONE) for i, _ in items]  # below every line of that ratio
        for batch in batches:
            texts, docs, lines = (batch[c].to_pylist() for c in ("text", "doc_id", "line_id"))
            lower = [t.lower() for t in texts]
            length, have = np.array([len(t) for t in lower]), _counts(lower)
            for k, (_, item) in enumerate(items):
                both = np.maximum(length + sizes[k], 1)
                none = length + sizes[k] == 0
                near = np.flatnonzero(none | (2 * np.minimum(length, sizes[k]) / both >= best[k][0] - 1e-6))
                bound = np.where(none[near], 1.0, 2 * np.minimum(have[near], counts[k]).sum(1) / both[near])
                order = np.argsort(-bound, kind="stable")
                tried = 0
                for j, top in zip(near[order].tolist(), bound[order].tolist()):
                    key = (-docs[j], -lines[j])
                    if round(top, 6) < best[k][0] or most is not None and tried >= most:
                        break
                    if (round(top, 6), *key) <= best[k]:
                        continue
                    reach = 1.0 if none[j] else 2 * seeded(low[k], lower[j]) / both[j] if length[j] >= 200 else 2 * common(places[k], len(low[k]), lower[j]) / both[j]
                    tried += 1
                    if (round(reach, 6), *key) > best[k]:
                        best[k] = max(best[k], (similarity(item, texts[j]), *key))
        rows = [(i, *b) for (i, _), b in zip(items, best, strict=True) if b[1] > NONE]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["item_id", "ratio", "d", "l"])

    return run


def nearest_lines(items: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, ratio, doc_id, line_id: the line that is most like each item (item_id,
    text) among all lines (doc_id, line_id, text), the first one of equals. Whole texts
    are compared. ITEMS items at a time go through the lines, first a few lines of each
    batch for a ratio that is reached, then all lines against it."""
    once = rows.where("text IS NOT NULL").groupBy("text").agg(F.min(F.struct("doc_id", "line_id")).alias("at"))
    once = once.select("text", F.col("at.doc_id").cast("long").alias("doc_id"), F.col("at.line_id").cast("long").alias("line_id"))
    once = once.repartition(max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # as many tasks: comparing costs more than moving
    schema, found = "item_id long, ratio double, d long, l long", []

    def one_pass(block: list[tuple[int, str]], known: dict[int, float], most: int | None) -> DataFrame:
        return once.mapInArrow(_nearest(block, known, most), schema).groupBy("item_id").agg(F.max(F.struct("ratio", "d", "l")).alias("best"))

    def best_of(block: list[tuple[int, str]]) -> DataFrame:
        known = {r["item_id"]: r["best"]["ratio"] for r in one_pass(block, {}, 2).collect()}
        return one_pass(block, known, None)

    block: list[tuple[int, str]] = []
    for r in items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEMS:
            found.append(best_of(block))
            block = []
    if block or not found:
        found.append(best_of(block))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("item_id", "best.ratio", (-F.col("best.d")).alias("doc_id"), (-F.col("best.l")).alias("line_id"))


def weighted_folds(rows: DataFrame, key: str, label: str, pred: str, k: int) -> DataFrame:
    """fold, precision, recall, f1, weighted by support: k folds of rows in the order of a
    number, each of neighbours. Folds come from global ranks, not from one sorted task."""
    from .relational import global_order

    n = rows.count()
    ranked = global_order(rows.withColumn("__key", -F.col(key)), "__key", [key], "__rank")
    folds = ranked.withColumn("fold", F.floor(F.col("__rank") * k / max(n, 1)).cast("long"))
    hit = (F.col(label) == F.col(pred)).cast("int")
    true = folds.groupBy("fold", F.col(label).alias("c")).agg(F.count("*").alias("support"), F.sum(hit).alias("tp"))
    said = folds.groupBy("fold", F.col(pred).alias("c")).agg(F.count("*").alias("p"))
    each = true.join(said, ["fold", "c"], "left").select("fold", "support", (F.col("tp") / F.col("support")).alias("r"), F.coalesce(F.col("tp") / F.col("p"), F.lit(0.0)).alias("pr"))
    each = each.withColumn("f", F.coalesce(F.try_divide(2 * F.col("pr") * F.col("r"), F.col("pr") + F.col("r")), F.lit(0.0)))
    mean = lambda c, name: F.round(F.sum(F.col("support") * F.col(c)) / F.sum("support"), 6).alias(name)
    return each.groupBy("fold").agg(mean("pr", "precision"), mean("r", "recall"), mean("f", "f1"))


def teds(a: tuple, b: tuple) -> float:
    """Similarity of two trees (label, children...): 1 - edit distance / size of the larger
    one. Inserting, deleting and renaming a node cost 1."""

    def flat(t: tuple) -> tuple[list, list[int], list[int]]:
        names, left, keys = [], [], {}

        def walk(n: tuple) -> int:
            first = None
            for child in n[1:]:
                at = walk(child)
                first = at if first is None else first
            names.append(n[0])
            left.append(first if first is not None else len(names) - 1)
            keys[left[-1]] = len(names) - 1
            return left[-1]

        walk(t)
        return names, left, sorted(keys.values())

    (na, la, ka), (nb, lb, kb) = flat(a), flat(b)
    cost = [[0] * len(nb) for _ in na]
    for i in ka:
        for j in kb:
            x, y = la[i], lb[j]
            rows, cols = i - x + 2, j - y + 2
            d = [[0] * cols for _ in range(rows)]
            for r in range(1, rows):
                d[r][0] = r
            for c in range(1, cols):
                d[0][c] = c
            for r in range(1, rows):
                for c in range(1, cols):
                    p, q = x + r - 1, y + c - 1
                    if la[p] == x and lb[q] == y:
                        d[r][c] = min(d[r - 1][c] + 1, d[r][c - 1] + 1, d[r - 1][c - 1] + (na[p] != nb[q]))
                        cost[p][q] = d[r][c]
                    else:
                        d[r][c] = min(d[r - 1][c] + 1, d[r][c - 1] + 1, d[la[p] - x][lb[q] - y] + cost[p][q])
    return 1 - cost[-1][-1] / max(len(na), len(nb))
