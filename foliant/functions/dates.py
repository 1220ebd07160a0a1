"""Dates as ISO strings (a day is only checked to be 1 to 31), contract terms, PDF dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let

# Month names.
MONTHS_PT = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Patterns.
DMY = r"\b(0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.](\d{4})\b"
ISO = r"\b(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b"
TEXTUAL = r"(?iu)\b(0?[1-9]|[12]\d|3[01])\s+(?:de\s+)?([a-záéíóúàâêôãõç]+)\s+(?:de\s+)?(\d{4})\b"
_D = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
TERM = rf"(?iu)vig[eê]ncia[:\s]+(?:de\s+)?({_D})\s+(?:a|até|ao|ate)\s+({_D})"
VALID = rf"(?iu)v[aá]lid[oa]?\s+(?:até|ate|a partir de)?\s*[:\s]*({_D})"
DUE = rf"(?iu)vencimento[:\s]+({_D})"
END = rf"(?iu)t[eé]rmino[:\s]+({_D})"
START = rf"(?iu)(?:data\s+de\s+inicio|início|início\s+da\s+vigência)[:\s]+({_D})"
LENGTH = r"(?iu)prazo[:\s]+(?:de\s+)?(\d+)\s+(m[eê]s(?:es)?|ano(?:s)?|dia(?:s)?)"
RENEWAL = r"(?iu)renova[çc][aã]o\s+autom[aá]tica"


def iso(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int"))


def month_number(name: Column) -> Column:
    n = F.lower(name)
    out = F.when(n == "marco", F.lit(3))
    for months in (MONTHS_PT, MONTHS_EN):
        for i, m in enumerate(months):
            out = out.when(n == m, F.lit(i + 1))
    return out


def extract_dates(text: Column, most: int = 30) -> Column:
    """ISO strings from 1800 to 2100: day-month-year first, then ISO, then with month names, each in order, distinct."""
    head = F.substring(text, 1, 50_000)

    def all_of(pattern: str, y: int, m: int, d: int) -> Column:
        g = lambda x, n: F.regexp_extract(x, pattern, n)
        month = (lambda x: month_number(g(x, m))) if pattern is TEXTUAL else (lambda x: g(x, m).try_cast("int"))
        made = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), lambda x: F.when(g(x, y).try_cast("int").between(1800, 2100) & month(x).between(1, 12), iso(g(x, y), month(x), g(x, d))))
        return F.filter(made, lambda x: x.isNotNull())

    return F.slice(F.array_distinct(F.concat(all_of(DMY, 3, 2, 1), all_of(ISO, 1, 2, 3), all_of(TEXTUAL, 3, 2, 1))), 1, most)


def valid(y: Column, m: Column, d: Column, last_year: int) -> Column:
    return y.try_cast("int").between(1900, last_year) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)


def parse_date(raw: Column, last_year: int = 2036) -> Column:
    """ISO, then day de month de year, then day/month/year with two-digit years from 1950 to 2049; else null."""
    return let(raw, lambda r: _parsed(r, last_year))


def _parsed(raw: Column, last_year: int) -> Column:
    g = lambda p, n: F.regexp_extract(raw, p, n)
    dashed, named, slashed = r"(\d{4})-(\d{2})-(\d{2})", r"(?iu)(\d{1,2})\s+de\s+([a-zç]+)\s+de\s+(\d{4})", r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})"
    year = g(slashed, 3).try_cast("int")
    year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    short = F.lower(F.substring(g(named, 2), 1, 3))
    month = F.coalesce(month_number(g(named, 2)), *[F.when((F.length(g(named, 2)) == 3) & (short == m[:3]), F.lit(i + 1)) for i, m in enumerate(MONTHS_PT)])
    return F.coalesce(
        F.when(valid(g(dashed, 1), g(dashed, 2), g(dashed, 3), last_year), iso(g(dashed, 1), g(dashed, 2), g(dashed, 3))),
        F.when(valid(g(named, 3), month, g(named, 1), last_year), iso(g(named, 3), month, g(named, 1))),
        F.when(valid(year, g(slashed, 2), g(slashed, 1), last_year), iso(year, g(slashed, 2), g(slashed, 1))),
    )


def months(quantity: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.contains("ano"), quantity * 12).when(u.contains("dia"), F.greatest(F.lit(1), F.floor(quantity / 30).try_cast("int"))).otherwise(quantity)


def contract_terms(text: Column) -> dict[str, Column]:
    """start_date, end_date, duration_months, auto_renewal, confidence. An end from a duration keeps the start's day as it is.

    Each part is bound once: written out, the expression outgrows the driver as soon as text is a table's column."""
    g = lambda p, n=1: F.regexp_extract(text, p, n)
    found = F.struct(
        parse_date(g(TERM, 1)).alias("from_term"),
        parse_date(g(TERM, 2)).alias("to_term"),
        F.coalesce(parse_date(g(VALID)), parse_date(g(DUE)), parse_date(g(END))).alias("other_end"),
        parse_date(g(START)).alias("other_start"),
        F.when(g(LENGTH) != "", months(g(LENGTH).try_cast("int"), g(LENGTH, 2))).alias("duration"),
    )

    def joined(p: Column) -> Column:
        start, duration = F.coalesce(p["from_term"], p["other_start"]), p["duration"]
        stated = F.coalesce(p["to_term"], p["other_end"])
        total = F.substring(start, 6, 2).try_cast("int") + duration - 1
        computed = iso(F.substring(start, 1, 4).try_cast("int") + F.floor(total / 12).try_cast("int"), total % 12 + 1, F.substring(start, 9, 2))
        computed = F.when(F.try_to_timestamp(start).isNotNull(), computed)
        n = F.when(p["from_term"].isNotNull() | p["to_term"].isNotNull(), F.lit(2)).otherwise(F.lit(0))
        n = n + F.when(p["to_term"].isNull() & p["other_end"].isNotNull(), F.lit(1)).otherwise(F.lit(0)) + F.when(p["from_term"].isNull() & start.isNotNull(), F.lit(1)).otherwise(F.lit(0))
        n = n + F.when(stated.isNull() & computed.isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return F.struct(start.alias("start_date"), F.coalesce(stated, computed).alias("end_date"), duration.alias("duration_months"), F.least(F.lit(1.0), n / 3).alias("confidence"))

    terms = let(found, joined)
    return {"start_date": terms["start_date"], "end_date": terms["end_date"], "duration_months": terms["duration_months"], "auto_renewal": text.rlike(RENEWAL), "confidence": terms["confidence"]}


def pdf_date(raw: Column) -> Column:
    """D:YYYYMMDD… to ISO; null where month or day is out of range."""
    p = r"D:(\d{4})(\d{2})(\d{2})"
    g = lambda n: F.regexp_extract(raw, p, n)
    return F.when(g(2).try_cast("int").between(1, 12) & g(3).try_cast("int").between(1, 31), iso(g(1), g(2), g(3)))


def pdf_timestamp(raw: Column) -> Column:
    """D:YYYYMMDDHHMMSS with Z or +HH'MM' to UTC; null where impossible. Without a zone: UTC."""
    p = r"D:(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?(Z|[+-]\d{2}'\d{2})?"
    g = lambda n: F.regexp_extract(raw, p, n)
    part = lambda n: F.coalesce(F.nullif(g(n), F.lit("")), F.lit("00"))
    at = F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = g(7)
    minutes = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)


def shown_pdf_date(raw: Column) -> Column:
    """D:YYYYMMDD[HHMM…] as DD/MM/YYYY[ HH:MM]; null for a date or time that there can't be."""
    g = lambda n: F.regexp_extract(F.trim(raw), r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?", n)
    day = F.concat_ws("/", g(3), g(2), g(1))
    timed = (g(4) != "") & (g(5) != "")
    at = F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.when(timed, F.concat(F.lit(" "), g(4), F.lit(":"), g(5))).otherwise(F.lit(" 00:00"))), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(at.isNotNull(), F.when(timed, F.concat(day, F.lit(" "), g(4), F.lit(":"), g(5))).otherwise(day))


def any_date(raw: Column) -> Column:
    """The first that parses: PDF date, ISO, day de month de year, day/month/year (two-digit years from 1950 to 2049)."""
    return F.coalesce(pdf_date(raw), parse_date(raw))


def partial_iso(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as far as the parts are given; a day without a month doesn't count."""
    m, d = (F.lit(None).cast("int") if c is None else F.when(c != 0, c) for c in (month, day))
    y = F.format_string("%04d", year)
    return F.when(m.isNull(), y).when(d.isNull(), F.concat_ws("-", y, F.format_string("%02d", m))).otherwise(F.concat_ws("-", y, F.format_string("%02d", m), F.format_string("%02d", d)))


def normalized_dates(raw: Column) -> Column:
    """The dates that an array of texts holds, in any of the known forms, distinct in their order; others are left out."""
    return F.array_distinct(F.filter(F.transform(raw, any_date), lambda d: d.isNotNull()))
