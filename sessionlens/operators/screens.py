"""Texts read from the screen: platform clocks, results and positions. Confidence below one half gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc

#: Dates that are cut out first, clock patterns in order of preference, least confidence.
DATE = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}"
CLOCKS = ((r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,6})?", 1), (r"\d{1,2}[:.\-]\d{2}[:.\-]\d{2}(?:[.,]\d{1,6})?", 1), (r"\d{1,2}:\d{2}(?![:.\-\d])", 60))
MIN_CONFIDENCE = 0.5
DAY_US = 86_400_000_000


def _parts_of(resolution: int) -> Callable[[Column], Column]:
    def parts(m: Column) -> Column:
        def n(i: int) -> Column:
            return F.coalesce(F.try_element_at(F.split(m, r"[:.,\-]"), F.lit(i)).try_cast("long"), F.lit(0))

        frac = F.coalesce(F.try_element_at(F.split(m, r"[:.,\-]"), F.lit(4)), F.lit(""))
        second = n(3) if resolution == 1 else F.lit(0).cast("long")
        return F.struct(n(1).alias("h"), n(2).alias("m"), second.alias("s"), F.rpad(frac, 6, "0").try_cast("long").alias("us"), F.lit(resolution).alias("resolution"))

    return parts


def _clock(text: Column) -> Column:
    """hour, minute, second, micro and resolution (1 or 60) of the first valid clock; colons before other marks before minutes alone."""
    plain = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), DATE, " ")
    found = []
    for pattern, resolution in CLOCKS:
        every = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), _parts_of(resolution))
        found.append(F.try_element_at(F.filter(every, lambda x: (x.h <= 23) & (x.m <= 59) & (x.s <= 59)), F.lit(1)))
    return F.coalesce(*found)


def clock_us(text: Column, expected_us: Column, confidence: Column) -> Column:
    """Microseconds of the clock on the day that lies within twelve hours of the expected time."""
    c = _clock(text)
    day = F.floor(expected_us / DAY_US) * DAY_US
    at = day + ((c["h"] * 60 + c["m"]) * 60 + c["s"]) * 1_000_000 + c["us"]
    gap = at - expected_us
    moved = F.when(gap < -DAY_US / 2, at + DAY_US).when(gap > DAY_US / 2, at - DAY_US).otherwise(at)
    return F.when(confidence >= MIN_CONFIDENCE, moved)


def clock_resolution(text: Column) -> Column:
    return _clock(text)["resolution"]


def decimal(raw: Column) -> Column:
    """A number with European or US separators: the last of both kinds is the decimal mark; a lone comma is one before one or two digits."""
    comma, dot = F.instr(F.reverse(raw), ","), F.instr(F.reverse(raw), ".")
    european = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(raw, F.lit(","), F.lit(""))
    text = F.when((comma > 0) & (dot > 0), F.when(comma < dot, european).otherwise(plain)).when(comma > 0, F.when(comma.isin(2, 3), european).otherwise(plain)).otherwise(raw)
    return text.try_cast("double")


def result(text: Column, confidence: Column) -> Column:
    """A result such as $1,234.50, (12,5) or -3: parentheses and minus signs are negative."""
    compact = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[\s'$€£]|USD|EUR", "")
    inner = F.regexp_extract(compact, r"\(([\d.,]+)\)", 1)
    raw = F.when(inner != "", inner).otherwise(F.regexp_extract(compact, r"[+\-−–]?(\d[\d.,]*)", 1))
    negative = (inner != "") | F.regexp_extract(compact, r"([+\-−–]?)\d", 1).isin("-", "−", "–")
    v = decimal(F.regexp_replace(raw, r"[.,]+$", ""))
    return F.when(confidence >= MIN_CONFIDENCE, F.when(negative, -v).otherwise(v))


def position(text: Column, confidence: Column) -> Column:
    """A signed number of contracts; flat is 0."""
    t = nfkc(F.coalesce(text, F.lit("")))
    flat = t.rlike(r"(?i)\bflat\b")
    compact = F.replace(t, F.lit(" "), F.lit(""))
    digits = F.regexp_extract(compact, r"[+\-−–]?(\d+)", 1).try_cast("long")
    signed = F.when(F.regexp_extract(compact, r"([+\-−–]?)\d+", 1).isin("-", "−", "–"), -digits).otherwise(digits)
    return F.when(confidence >= MIN_CONFIDENCE, F.when(flat, F.lit(0).cast("long")).otherwise(signed))
