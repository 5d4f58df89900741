"""Tasks for labelling, transfer of labels, and reports on results and times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import ratio


def tasks(lines: DataFrame, size: int) -> DataFrame:
    """task_id: lines of a document in pieces of a size."""
    w = Window.partitionBy("doc_id").orderBy("page_id", "line_id")
    return lines.withColumn("task_id", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def toc_pages(lines: DataFrame, is_toc: str = "is_toc") -> DataFrame:
    """Lines on the first two pages and on pages with a line of a table of contents."""
    on_page = F.max(F.col(is_toc).cast("int")).over(Window.partitionBy("doc_id", "page_id")) == 1
    return lines.withColumn("toc", on_page).where("page_id < 2 OR toc").drop("toc")


def transfer(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels by uid; where several rows of one uid disagree, the least label."""
    return lines.join(labelled.groupBy("uid").agg(F.min("label").alias("label")), "uid")


def averages(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each document's matched, mismatched, missed and added
    entries, averaged over documents with their population deviation."""
    c = F.col
    p, r = ratio(c("matched"), c("matched") + c("added") + c("mismatched")), ratio(c("matched"), c("matched") + c("missed") + c("mismatched"))
    per = counts.select(p.alias("precision"), r.alias("recall")).withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    out = [f for n in ("precision", "recall", "f1") for f in (F.round(F.avg(n), 6).alias(f"mean_{n}"), F.round(F.stddev_pop(n), 6).alias(f"std_{n}"))]
    return per.agg(F.count("*").alias("n_docs"), *out)


def timing(runs: DataFrame, cpu_score: float = 1.0) -> DataFrame:
    """Files, seconds and bytes of each dataset: throughput and means, by a CPU score."""
    seconds = F.sum("seconds")
    return runs.groupBy("dataset").agg(
        F.count("*").alias("n_files"), F.round(seconds, 4).alias("total_seconds"), F.round(seconds / F.count("*"), 6).alias("seconds_per_file"),
        F.round(F.try_divide(seconds, F.sum("pages")), 6).alias("seconds_per_page"), F.round(seconds / F.count("*") * cpu_score, 6).alias("normalised"),
    )


def report_averages(reports: DataFrame, text: str = "report") -> DataFrame:
    """Numbers of text recognition reports, averaged by dataset."""
    pick = lambda p: F.regexp_extract(text, p, 1).try_cast("double")
    seen = reports.select("dataset", pick(r"(\d+)\s+Characters").alias("n_chars"), pick(r"(\d+)\s+Errors").alias("n_errors"), pick(r"([\d.]+)%\s+Accuracy").alias("accuracy"))
    return seen.groupBy("dataset").agg(F.count("*").alias("n_reports"), *[F.round(F.avg(c), 6).alias(c) for c in ("n_chars", "n_errors", "accuracy")])


def transfer_fuzzy(lines: DataFrame, labelled: DataFrame, near: int = 50, share: float = 0.8) -> DataFrame:
    """Lines (doc_id, line_id, text) with the label of the first labelled line of the document
    that is at most `near` lines away and more alike than the share; null without one.
    Candidates meet by buckets of places; pairs of equal texts need no comparison, others
    are compared once a distinct pair of a batch."""
    from .relational import near_join

    pairs = near_join(lines.select("doc_id", "line_id", "text"), labelled.select("doc_id", "line_id", "text", "label"), ["doc_id"], "line_id", near)
    lengths = (F.length("text") + F.length("r_text")).cast("double")
    possible = 2 * F.least(F.length("text"), F.length("r_text")) > share * lengths  # no more letters can be common
    alike = (F.col("text") == F.col("r_text")) | (indel("text", "r_text") > share)
    found = pairs.where((F.col("text") == F.col("r_text")) | possible).where(alike).groupBy("doc_id", "line_id").agg(F.min_by("r_label", "r_line_id").alias("label"))
    return lines.join(found, ["doc_id", "line_id"], "left")


def indel(a: str, b: str):
    """Twice the longest common subsequence by the summed length, for pairs of a batch."""
    from ..functions.text import indel_ratio

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, indel_ratio(*p)) for p in zip(left, right)])

    return run(a, b)


def assemble(features: DataFrame, labels: DataFrame, mapping: dict[str, str], group: str) -> DataFrame:
    """Features with their labels, renamed where the mapping has a name, and their group."""
    new = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("label")]
    return features.join(labels, "doc_id").withColumn("label", F.coalesce(new, F.col("label"))).withColumn("grp", F.col(group))


def match_titles(truth: DataFrame, found: DataFrame, share: float = 0.85) -> DataFrame:
    """doc_id, correct, added, missed: each true title (doc_id, pos, text) in order takes the
    unmatched found title that is most like it, if more than the share. One document's
    titles are one group."""
    from ..functions.text import indel_ratio

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = list(b.sort_values("pos")["text"])
        n, correct = len(free), 0
        for text in a.sort_values("pos")["text"]:
            scores = [indel_ratio(text, x) for x in free]
            if scores and max(scores) > share:
                free.pop(scores.index(max(scores)))
                correct += 1
        return pd.DataFrame({"doc_id": [key[0]], "correct": [correct], "added": [n - correct], "missed": [len(a) - correct]})

    return truth.groupBy("doc_id").cogroup(found.groupBy("doc_id")).applyInPandas(run, "doc_id long, correct long, added long, missed long")


def with_truth(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines with the depth of the true title (doc_id, page_id, text, depth) on their page
    that reads the same but for case and blanks at the ends; null where there is none."""
    key = lambda c: F.lower(F.trim(c)).alias("__key")
    truth = titles.groupBy("doc_id", "page_id", key("text")).agg(F.min("depth").alias("depth"))
    return lines.withColumn("__key", key("text")).join(truth, ["doc_id", "page_id", "__key"], "left").drop("__key")
