"""Checks of document metadata: anomalies, score and summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.dates import pdf_timestamp

# Weights, cap and threshold of the risk score; producers that don't fit a creator.
WEIGHTS = {"low": 5, "medium": 20, "high": 40}
CAP, SUSPICIOUS = 100, 40
PAIRS = [("microsoft word", "ghostscript"), ("microsoft word", "gpl ghostscript"), ("microsoft excel", "ghostscript"), ("microsoft excel", "gpl ghostscript"), ("libreoffice", "ghostscript"), ("libreoffice", "gpl ghostscript"), ("acrobat distiller", "ghostscript"), ("microsoft word", "itext"), ("microsoft word", "itextsharp"), ("scan", "microsoft"), ("scanner", "microsoft")]


def _anomaly(kind: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))


def anomalies(created: Column, modified: Column, creator: Column, producer: Column, author: Column) -> Column:
    """array of (type, severity), one of each kind at most."""
    pair = F.lit(False)
    for a, b in PAIRS:
        pair = pair | (F.lower(creator).contains(a) & F.lower(producer).contains(b))
    zoned = lambda c: c.rlike(r"(Z|[+-]\d{2}'?\d{2}'?)$")
    checks = [
        _anomaly("creation_after_modification", "high", pdf_timestamp(created) > pdf_timestamp(modified)),
        _anomaly("producer_creator_mismatch", "medium", pair),
        _anomaly("missing_timezone", "low", ((created != "") & ~zoned(created)) | ((modified != "") & ~zoned(modified))),
        _anomaly("empty_author", "low", (F.trim(F.coalesce(author, F.lit(""))) == "") & (F.trim(producer) != "")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def risk_score(found: Column) -> Column:
    weight = lambda s: F.coalesce(*[F.when(s == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(0))
    return F.least(F.aggregate(found, F.lit(0), lambda a, x: a + weight(x["severity"])), F.lit(CAP))


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, F.lit("high")).when(score >= SUSPICIOUS, F.lit("medium")).otherwise(F.lit("low"))


# Fonts of written text, the layout of XMP dates, limits.
TEXT_FONTS = ["arial", "times new roman", "helvetica", "calibri", "verdana"]
XMP_CREATED = r"(?i)<xmp:CreateDate>\s*([^<]+)\s*</xmp:CreateDate>"
XMP_DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}))?(Z|[+-]\d{2}:\d{2})?"
APART_SECONDS, OLD_VERSION, NEW_YEAR, OBJECTS_PER_KB = 86_400, 1.4, 2010, 50


def xmp_timestamp(raw: Column) -> Column:
    """ISO 8601, with or without a time and a zone, to UTC; null where impossible. Without a zone: UTC."""
    g = lambda n: F.regexp_extract(F.trim(raw), XMP_DATE, n)
    part = lambda n: F.coalesce(F.nullif(g(n), F.lit("")), F.lit("00"))
    zone = F.when(g(7).rlike("^[+-]"), g(7)).otherwise(F.lit("+00:00"))
    return F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6), zone))


def xmp_created(xmp: Column) -> Column:
    return xmp_timestamp(F.regexp_extract(xmp, XMP_CREATED, 1))


def scan_anomalies(created: Column, producer: Column, xmp: Column, version: Column, fonts: Column, n_objects: Column, file_size: Column) -> Column:
    """array of (type, severity) that need the file: metadata layers a day apart, a version too old for its date, fonts of written
    text in a scan, many objects for the size. fonts: names of the first pages. A null argument raises nothing."""
    apart = F.abs(F.unix_timestamp(xmp_created(xmp)) - F.unix_timestamp(pdf_timestamp(created)))
    written = F.exists(fonts, lambda f: F.lower(f).rlike("|".join(TEXT_FONTS)))
    checks = [
        _anomaly("xmp_docinfo_date_conflict", "high", apart > APART_SECONDS),
        _anomaly("pdf_version_anachronism", "medium", (version.try_cast("double") < OLD_VERSION) & (F.year(pdf_timestamp(created)) > NEW_YEAR)),
        _anomaly("text_fonts_in_scanned_document", "medium", F.lower(producer).contains("scan") & written),
        _anomaly("high_xref_ratio", "low", F.when(file_size > 0, n_objects / (file_size / 1024) > OBJECTS_PER_KB)),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def summary(found: Column, score: Column) -> Column:
    n = F.size(found)
    level = F.when(score >= 80, F.lit("risco elevado")).when(score >= SUSPICIOUS, F.lit("risco médio")).otherwise(F.lit("risco baixo"))
    noun = F.when(n == 1, F.lit(" anomalia detectada (")).otherwise(F.lit(" anomalias detectadas ("))
    return F.when(n == 0, F.lit("Nenhuma anomalia detectada.")).otherwise(F.concat(n.cast("string"), noun, level, F.lit(")")))
