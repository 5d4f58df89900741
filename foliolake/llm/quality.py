"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule needs one measure of the text and rejects on a comparison. A sample gives
the seconds that a rule takes a document and the share it rejects; the rules then run
in the order of rejections per second (with independent rules the cheapest order),
each over the documents that all rules before it let pass. The order changes the time
and which rule is named, never which documents are kept.

Cases: a null text counts as empty and has no words; an empty table gives an empty
result; repeated rows are judged one by one; helper columns carry a prefix of their own.
`keep_good` leaves extra columns of any name as they are; `measure` adds columns of fixed
names, which take the place of input columns named so."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

P = "__q_"
SPACES = r" \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
METRICS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _text() -> Column:
    return F.coalesce(F.col(P + "text"), F.lit(""))


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn whose value is computed once and in its place. The optimiser doesn't
    move a filter below a generator; below a projection it would, with a copy of the
    whole expression for each time that the filter or a later column names it."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_words(df: DataFrame) -> DataFrame:
    """Adds the array of words and their number."""
    trimmed = F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM coalesce({P}text, ''))")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    return fixed(df, P + "words", words).withColumn("n_words", F.size(P + "words").cast("long"))


def with_word_chars(df: DataFrame) -> DataFrame:
    return fixed(df, "word_chars", F.length(F.translate(_text(), " \t\n\x0b\f\r", "")).cast("long"))


def with_symbols(df: DataFrame) -> DataFrame:
    return fixed(df, "n_symbols", (F.length(_text()) - F.length(F.translate(_text(), SYMBOLS, ""))).cast("long"))


def with_dup_lines(df: DataFrame) -> DataFrame:
    lines = F.filter(F.split(_text(), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = fixed(df, P + "lines", lines)
    return fixed(out, "n_dup_lines", (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long")).drop(P + "lines")


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Words in 3-word windows that the text has twice or more. The windows' hashes
    are sorted with their positions in the low bits; windows found again are those
    with an equal neighbour. Sorting keeps this n log n for texts of any length."""
    w, n, win, bits, packed, at = (P + x for x in ("words", "n", "win", "bits", "packed", "at"))
    out = fixed(df, win, F.expr(f"transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> xxhash64(x, {w}[i + 1], {w}[i + 2]))")).drop(w)
    out = out.withColumn(n, F.size(win)).withColumn(bits, F.length(F.bin(F.col(n).cast("long"))))
    some = F.expr(f"{n} > size(array_distinct({win}))")  # else no window is found again
    out = fixed(out, packed, F.when(some, F.expr(f"sort_array(transform({win}, (x, i) -> shiftleft(x, {bits}) | cast(i AS bigint)))")))
    same = "coalesce(shiftright({a}, {bits}) = shiftright({b}, {bits}) AND {win}[cast({a} & (shiftleft(1L, {bits}) - 1) AS int)] = {win}[cast({b} & (shiftleft(1L, {bits}) - 1) AS int)], false)"
    left = same.format(a="x", b=f"get({packed}, i - 1)", bits=bits, win=win)
    right = same.format(a="x", b=f"get({packed}, i + 1)", bits=bits, win=win)
    found = F.expr(f"sort_array(transform(filter({packed}, (x, i) -> {left} OR {right}), x -> x & (shiftleft(1L, {bits}) - 1)))")
    out = fixed(out, at, found)
    total = F.expr(f"aggregate(transform({at}, (x, i) -> least(3L, coalesce(get({at}, i + 1) - x, 3L))), 0L, (a, b) -> a + b)")
    return fixed(out, "n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(win, n, bits, packed, at)


ADD: dict[str, Callable[[DataFrame], DataFrame]] = {"word_chars": with_word_chars, "n_symbols": with_symbols, "n_dup_lines": with_dup_lines, "n_repeat_words": with_repeat_words}


@dataclass(frozen=True)
class Rule:
    """Rejects where `reject` is true; `metric` is the measure it needs besides n_words."""

    name: str
    metric: str | None
    reject: str


#: The base rules first; then bounds for symbols a word, mean word length and lines met again.
RULES = (
    Rule("few_words", None, "n_words < 50"),
    Rule("repeated_windows", "n_repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("repeated_lines", "n_dup_lines", "n_dup_lines >= 5 AND 20 * n_dup_lines > n_words"),
)


def _only(df: DataFrame, rule: Rule) -> DataFrame:
    """The measures of one rule."""
    df = with_words(df)
    df = ADD[rule.metric](df) if rule.metric else df
    return df.drop(P + "words")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = 1000, text: str = "text", seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, rejected share), best rejection per cost first,
    from about sample_docs documents drawn from the whole table."""
    total = docs.count()
    narrow = docs.select(F.col(text).cast("string").alias(P + "text"))
    drawn = keep(narrow if total <= sample_docs else narrow.sample(sample_docs / total, seed), "sample")
    found, shared = [], None
    for rule in (None, None, *rules):  # the first run only warms up, the second one takes what all rules share
        df = with_words(drawn) if rule is None else _only(drawn, rule)
        began = time.perf_counter()
        n, _, bad = df.agg(F.count("*"), F.sum("n_words"), F.count_if(F.expr(rule.reject if rule else "false"))).first()
        took = (time.perf_counter() - began) / max(n, 1)
        shared = took if rule is None else shared
        if rule:
            # a rule on the words alone costs a comparison: a thousandth of what all share
            found.append((rule, max(took - shared, shared / 1000), bad / max(n, 1)))
    return sorted(found, key=lambda x: -x[2] / x[1])


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All measures and the verdict for every row: the input's columns, n_words, the
    four measures, base_failed, rejected_by (null: kept) and kept."""
    order = order_rules(docs, rules, text=text)
    df = with_words(docs.withColumn(P + "text", F.col(text).cast("string")).drop("n_words", *METRICS))
    for name in METRICS[::-1]:
        df = ADD[name](df)
    base = F.expr(" OR ".join(f"({r.reject})" for r in rules[:2]))
    verdict = F.lit(None).cast("string")
    for rule, _, _ in reversed(order):
        verdict = F.when(F.expr(rule.reject), F.lit(rule.name)).otherwise(verdict)
    df = df.withColumn("base_failed", base).withColumn("rejected_by", verdict)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(P + "text", P + "words")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns. A measure is taken of
    the rows that passed the rules before it only."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(P + "row"), F.col(text).cast("string").alias(P + "text"))
    df = with_words(df)
    for rule, _, _ in order_rules(docs, rules, text=text):
        if rule.metric:
            words = df.select("*", F.col(P + "words").alias(P + "kept_words"))
            df = ADD[rule.metric](words).drop(P + "words").withColumnRenamed(P + "kept_words", P + "words")
        df = df.where(~F.expr(rule.reject))
    return df.select(P + "row.*")
