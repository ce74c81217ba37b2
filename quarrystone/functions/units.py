"""Columns for concentrations of a gas in three units, and questions that ask to convert one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ppm in one per cent by volume, and per cent by volume at 100 % LEL.
PPM_IN_PERCENT, PERCENT_AT_LEL = 10_000.0, 4.0


def from_ppm(ppm: Column) -> Column:
    """``struct<ppm, percent_vv, percent_lel>`` of an amount in ppm."""
    vv = ppm.cast("double") / PPM_IN_PERCENT
    return F.struct(ppm.cast("double").alias("ppm"), vv.alias("percent_vv"), (vv * 100 / PERCENT_AT_LEL).alias("percent_lel"))


def from_percent_vv(vv: Column) -> Column:
    return from_ppm(vv.cast("double") * PPM_IN_PERCENT)


def from_percent_lel(lel: Column) -> Column:
    return from_percent_vv(lel.cast("double") * PERCENT_AT_LEL / 100)


def short(x: Column) -> Column:
    """A number without useless zeros, six digits of it at most."""
    text = F.format_string("%.6f", F.bround(x, 6))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def said(c: Column) -> Column:
    """``2,000 ppm = 0.2% v/v = 5% LEL``."""
    return F.concat(F.format_number(c["ppm"], 0), F.lit(" ppm = "), short(c["percent_vv"]), F.lit("% v/v = "), short(c["percent_lel"]), F.lit("% LEL"))


def contains(low: Column, high: Column, c: Column) -> Column:
    """Whether the closed range of two concentrations has a third in it."""
    return c["ppm"].between(low["ppm"], high["ppm"])


def said_range(low: Column, high: Column) -> Column:
    """``0 to 2,000 ppm (0% to 0.2% v/v)`` of two concentrations."""
    ends = F.concat(F.format_number(low["ppm"], 0), F.lit(" to "), F.format_number(high["ppm"], 0), F.lit(" ppm"))
    return F.concat(ends, F.lit(" ("), short(low["percent_vv"]), F.lit("% to "), short(high["percent_vv"]), F.lit("% v/v)"))


_AMOUNT = r"([\d,]*\d(?:\.\d+)?)\s*(ppm\b|%\s*lel\b|lel\s*%|percent\s*lel\b|%|percent\b)"
_TARGET = r"\bin(?:to)?\s+(ppm\b|%\s*lel\b|lel\s*%|percent\s*lel\b|%|percent\b)"


def unit_key(raw: Column) -> Column:
    u = F.regexp_replace(F.lower(raw), r"\s+", "")
    return F.when(F.contains(u, F.lit("lel")), "percent_lel").when(u == "ppm", "ppm").when(u.rlike(r"^(%|percent)"), "percent_vv")


def conversion(question: Column) -> Column:
    """What a question asks to convert: the amount in all units and the target; null if it doesn't, or names one unit twice.

    A sign of per cent counts wherever it stands, also before a blank or at the end.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    number = F.regexp_replace(F.regexp_extract(q, _AMOUNT, 1), ",", "")
    source, target = unit_key(F.regexp_extract(q, _AMOUNT, 2)), unit_key(F.regexp_extract(q, _TARGET, 1))
    x = number.try_cast("double")
    amount = F.when(source == "ppm", from_ppm(x)).when(source == "percent_vv", from_percent_vv(x)).when(source == "percent_lel", from_percent_lel(x))
    return F.when(x.isNotNull() & source.isNotNull() & target.isNotNull() & (source != target), F.struct(amount.alias("amount"), target.alias("target")))


def range_code(text: Column) -> Column:
    """``2K`` as 2000, a per cent as it is, null for other codes."""
    k = F.regexp_extract(text, r"^\s*([0-9.]+)\s*[Kk]\s*$", 1).try_cast("double")
    return F.when(k.isNotNull(), (k * 1000).cast("bigint").cast("string")).when(text.rlike(r"^\s*[0-9.]+\s*%\s*$"), F.regexp_replace(text, r"\s+", ""))


def span_cell(text: Column) -> Column:
    """``2,000 ppm`` as 2000 and ``5 vol%`` as 5%, null for other cells."""
    ppm = F.regexp_extract(text, r"(?i)^\s*([\d,]+)\s*ppm", 1)
    vol = F.regexp_extract(text, r"(?i)^\s*([\d.]+)\s*(?:vol\.?\s*%|%\s*v|%)", 1)
    return F.when(ppm != "", F.regexp_replace(ppm, ",", "")).when(vol != "", F.concat(vol, F.lit("%")))
