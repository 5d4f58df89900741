"""Scalar text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind on both ends (trim() knows U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def uid(*parts: Column) -> Column:
    """A deterministic content id."""
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]).cast("binary"))


def base64_line(c: Column) -> Column:
    """Base64 on one line; base64() breaks it after every 76 characters."""
    return F.translate(F.base64(c), "\r\n", "")


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """File name split; double extensions of compressed files stay together."""
    ext = F.regexp_extract(name, r"(?i)((\.(txt|tar|mht|mhtml)\.gz)|(\.note\.pickle)|(\.[^./]+))$", 1)
    return F.substring(name, 1, F.length(name) - F.length(ext)), ext


def url_parts(url: Column) -> tuple[Column, Column]:
    return F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1), F.regexp_extract(url, r"^[a-z]+://[^/]+(/.*)$", 1)



def indel_ratio(a: str, b: str) -> float:
    """2 x longest common subsequence / summed length."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def pdf_time(c: Column) -> Column:
    """Seconds since 1970 of a time as PDF files write it (D:YYYYMMDDHHmmSS, then an offset
    like +03'00' or Z), or of a common written date; null where none is found."""
    text = F.replace(c, F.lit("D:"), F.lit(""))
    digits = F.regexp_extract(text, r"^(\d{14})", 1)
    sign, hours, minutes = (F.regexp_extract(text, r"^\d{14}([+-])(\d{2})'?(\d{2})'?", i) for i in (1, 2, 3))
    offset = (hours.cast("long") * 3600 + minutes.cast("long") * 60) * F.when(sign == "-", -1).otherwise(1)
    exact = F.unix_timestamp(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
    day = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    short = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    loose = F.unix_timestamp(F.coalesce(F.try_to_timestamp(F.replace(day, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(short, F.lit("yyyy-MM-dd"))))
    return F.when(digits != "", F.when(sign != "", exact - offset).otherwise(exact)).otherwise(loose)


def capped_name(name: Column, most: int = 255) -> Column:
    """A file name of at most so many characters; the stem is cut, not the extension."""
    stem, ext = stem_and_extension(name)
    return F.concat(F.substring(stem, F.lit(1), most - F.length(ext)), ext)
