"""Hierarchy levels from patterns; a list of patterns compiles to one CASE expression."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The beginnings of list items.
DOTTED = r"^\s*(\d+\.)+(\d+)?\s*"
ROMAN = r"^\s*[ivxlcdm]\."
BRACKET = r"^\s*\d\)"
BRACKET_ROMAN = r"^\s*[ivxlcdm]\)"
LETTER = r"^\s*\w\)"
BULLET = r"^\s*(-|—|−|–|®|\.|•|\,|‚|©|⎯|°|\*|>|\| -|●|♣|①|▪|\*|\+)"


@dataclass(frozen=True)
class Pattern:
    """A line type with levels for lines that match: by a regular expression at the
    start of the stripped, lower-cased text, by a first word, or by the reader's tag.
    Levels that aren't given come from the tag, the numbering depth or a default."""

    name: str
    line_type: str | None = None
    regexp: str | None = None
    start_word: str | None = None
    tag: str | None = None
    level_1: float | None = None
    level_2: float | None = None
    default_level_1: float | None = None
    default_level_2: float | None = None
    can_be_multiline: bool | None = None
    depth: bool = False
    extra: dict = field(default_factory=dict)

    def matches(self, low: Column) -> Column:
        if self.tag == "any":
            return F.lit(True)
        if self.tag:
            return F.col("tag_type") == self.tag
        if self.start_word is not None:
            return low.startswith(self.start_word.lower())
        return low.rlike("(?U)" + (self.regexp if self.regexp.startswith("^") else f"^(?:{self.regexp})"))

    def result(self, low: Column) -> Column:
        parts = F.size(F.filter(F.split(strip(F.regexp_extract(low, DOTTED, 0)), r"\."), lambda x: x != "")).cast("double")
        number = lambda x: F.lit(x).cast("double")
        first, second = number(self.level_1), number(self.level_2)
        if self.tag:
            first = F.coalesce(F.col("tag_level_1") if self.tag != "any" or self.level_1 is None else first, first, number(self.default_level_1))
            found = F.when(low.rlike(DOTTED), parts)
            second = F.coalesce(F.col("tag_level_2"), second, number(self.default_level_2), *([] if self.tag == "any" else [found, F.lit(1.0)]))
        elif self.depth:
            second = F.coalesce(second, parts)
        kind = F.coalesce(F.col("tag_type"), F.lit(self.line_type)) if self.tag == "any" else F.lit(self.line_type)
        return F.struct(kind.alias("line_type"), first.alias("level_1"), second.alias("level_2"), F.lit(True if self.can_be_multiline is None else self.can_be_multiline).alias("can_be_multiline"))


DEFAULT = (
    Pattern("tag_header", "header", tag="header", default_level_1=1, can_be_multiline=False),
    Pattern("tag_list", "list_item", tag="list_item", default_level_1=2, can_be_multiline=False),
    Pattern("dotted_list", "list_item", regexp=DOTTED, level_1=2, depth=True, can_be_multiline=False),
    Pattern("roman_list", "list_item", regexp=ROMAN, level_1=3, level_2=1, can_be_multiline=False),
    Pattern("bracket_list", "list_item", regexp=BRACKET, level_1=4, level_2=1, can_be_multiline=False),
    Pattern("letter_list", "list_item", regexp=LETTER, level_1=5, level_2=1, can_be_multiline=False),
    Pattern("bullet_list", "list_item", regexp=BULLET, level_1=6, level_2=1, can_be_multiline=False),
    Pattern("tag", "raw_text", tag="any"),
)

_REGEXPS = {"dotted_list": DOTTED, "roman_list": ROMAN, "bracket_list": BRACKET, "bracket_roman_list": BRACKET_ROMAN, "letter_list": LETTER, "bullet_list": BULLET}


#: Patterns that users add by name, see plugins.pattern().
MAKERS: dict = {}


def parse_patterns(literal: str) -> tuple[Pattern, ...]:
    """Patterns from a literal list of dictionaries with a name and its parameters."""
    out = []
    for item in ast.literal_eval(literal):
        item = dict(item)
        name = item.pop("name", None)
        if name in MAKERS:
            out.append(MAKERS[name](**item))
            continue
        if name in _REGEXPS:
            item.setdefault("regexp", _REGEXPS[name])
            item.setdefault("line_type", "list_item")
            item["depth"] = name == "dotted_list"
        elif name in ("tag_header", "tag_list"):
            item["tag"] = "header" if name == "tag_header" else "list_item"
        elif name == "tag":
            item["tag"] = "any"
            item["line_type"] = item.pop("default_line_type", "raw_text")
        elif name not in ("regexp", "start_word"):
            raise ValueError(f"unknown pattern {name!r}")
        out.append(Pattern(name, **item))
    return tuple(out)


def assign_levels(lines: DataFrame, patterns: tuple[Pattern, ...] = DEFAULT) -> DataFrame:
    """Adds line_type, level_1, level_2 (null: lowest) and can_be_multiline; the first
    pattern that matches wins. Missing tag columns count as null."""
    for name, kind in (("tag_type", "string"), ("tag_level_1", "double"), ("tag_level_2", "double")):
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    columns = lines.columns
    lines = lines.withColumn("__low", F.lower(strip(F.col("text"))))  # once, not in every branch
    low, case = F.col("__low"), None
    for p in patterns:
        case = F.when(p.matches(low), p.result(low)) if case is None else case.when(p.matches(low), p.result(low))
    none = F.struct(F.lit("raw_text").alias("line_type"), F.lit(None).cast("double").alias("level_1"), F.lit(None).cast("double").alias("level_2"), F.lit(True).alias("can_be_multiline"))
    return lines.withColumn("hl", case.otherwise(none)).select(*columns, "hl.*")


def same_kind_next(kind: Column, a: Column, b: Column) -> Column:
    """Whether item b follows item a: numbers and letters by one, bullets unchanged,
    dotted numbers with one more part, one step, or back to a shorter one."""
    x, y = (F.transform(F.filter(F.split(c, r"\."), lambda t: t != ""), lambda t: t.try_cast("long")) for c in (a, b))
    prefix = lambda v, n: F.slice(v, F.lit(1), n)
    deeper = (F.size(y) == F.size(x) + 1) & (prefix(y, F.size(x)) == x) & (F.element_at(y, -1) == 1)
    level = (F.size(y) <= F.size(x)) & (F.size(y) >= 1) & (prefix(x, F.size(y) - 1) == prefix(y, F.size(y) - 1)) & (F.get(y, F.size(y) - 1) == F.get(x, F.size(y) - 1) + 1)
    letter = (F.ascii(b) == F.ascii(a) + 1) | (a.startswith("е") & b.startswith("ё")) | (a.startswith("ё") & b.startswith("ж"))
    return F.when(kind == "dotted", deeper | level).when(kind == "bracket", b.try_cast("long") == a.try_cast("long") + 1).when(kind == "letter", letter).when(kind == "bullet", a == b).otherwise(F.lit(True))
