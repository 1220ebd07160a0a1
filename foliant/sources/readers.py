"""Scans: the archive's catalog, pages and vectors from tables, files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import word_count
from foliant.schemas import AUDIT

#: Stand-ins for the types that a test table has none of, dealt by doc_id; the third is absent.
TYPES = ["contrato", "relatório", None, "fatura"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_id(key: Column) -> Column:
    """16 hex digits of a document's key."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 16)


def content_hash(content: Column) -> Column:
    """32 hex digits of the content."""
    return F.substring(F.sha2(content, 256), 1, 32)


def catalog(documents: DataFrame) -> DataFrame:
    """A catalog record for each document of a table (doc_id, text, lang, ...): one scan, no shuffle."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (n % len(TYPES) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 120).cast("int"))
    ocr = F.when(n % 3 == 0, (n % 101).cast("int"))
    return documents.select(
        file_id(n).alias("id"),
        n.alias("ingest_seq"),
        F.concat(F.lit("/archive/"), F.col("source"), F.lit("/doc-"), n.cast("string"), F.lit(".pdf")).alias("original_path"),
        F.concat(F.lit("doc-"), n.cast("string"), F.lit(".pdf")).alias("name"),
        F.size(F.split("text", "\n")).alias("num_pages"),
        kind.alias("doc_type"),
        word_count(F.col("text")).alias("word_count"),
        F.octet_length("text").cast("long").alias("file_size"),
        content_hash(F.col("text")).alias("content_hash"),
        F.col("lang").alias("language"),
        F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("indexed_at"),
        ocr.alias("ocr_percentage"),
        F.when(ocr.isNotNull(), 40.0 + n % 60).alias("ocr_avg_confidence"),
    )


def pages(documents: DataFrame, separator: str = "\n") -> DataFrame:
    """file_id, ingest_seq, page from 1, text: the parts of a text; a text without parts is page 1."""
    return documents.select(file_id(F.col("doc_id")).alias("file_id"), F.col("doc_id").alias("ingest_seq"), F.posexplode(F.split("text", separator)).alias("p", "text")).select("file_id", "ingest_seq", (F.col("p") + 1).alias("page"), "text")


def page_text(pages_text: DataFrame, doc: str, page: int) -> DataFrame:
    return pages_text.where((F.col("file_id") == doc) & (F.col("page") == page)).select("text")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; lines that can't be read are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def tail(log: DataFrame, seq: str, n: int, newest_first: bool = True) -> DataFrame:
    """The last n rows by seq. The n rows alone are sorted again for the other order."""
    last = log.orderBy(F.desc(seq)).limit(n)
    return last if newest_first else last.orderBy(seq)


def hyperlinks(pages_html: DataFrame) -> DataFrame:
    """page_id, pos, href of every link."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return pages_html.select("page_id", F.posexplode(links).alias("pos", "href"))


def html_tables(pages_html: DataFrame, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """page_id, table_index, n_rows, n_cols, text ("a | b" lines), cells of tables with so many rows and columns."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    tables = pages_html.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_index", "body"))
    rows = F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), bare))
    t = tables.withColumn("cells", cells)
    t = t.select("page_id", "table_index", F.size("cells").alias("n_rows"), F.coalesce(F.array_max(F.transform("cells", F.size)), F.lit(0)).alias("n_cols"), F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n").alias("text"), "cells")
    return t.where((F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols))


def tables_text(texts: Column) -> Column:
    """One searchable text of an array of tables' texts; blank ones are left out."""
    return F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n\n")


def page_xml_text(xml: Column) -> Column:
    """The lines of a PAGE XML document, with or without a namespace: the text of each line's first equivalent, else of every Unicode element."""
    lines = lambda path: F.filter(F.transform(F.xpath(xml, F.lit(path)), lambda t: F.trim(t)), lambda t: t != "")
    first = lines("//*[local-name()='TextLine']/*[local-name()='TextEquiv'][1]/*[local-name()='Unicode']/text()")
    return F.array_join(F.when(F.size(first) > 0, first).otherwise(lines("//*[local-name()='Unicode']/text()")), "\n")
