"""Exports and versioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe(c):
    return F.coalesce(c, F.lit(""))


def jsonl_rows(meta: DataFrame) -> DataFrame:
    """One JSON line for each record, with defaults for what is absent and dates cut to ten characters."""
    row = F.struct("id", "name", safe(F.col("doc_type")).alias("doc_type"), safe(F.col("language")).alias("language"), F.coalesce("num_pages", F.lit(0)).alias("num_pages"), F.substring(safe(F.col("indexed_at")), 1, 10).alias("indexed_at"))
    return meta.select("ingest_seq", F.to_json(row).alias("line"))


def csv_rows(meta: DataFrame) -> DataFrame:
    """Flat rows; arrays joined with "; "."""
    flat = [F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c) if t.startswith("array") else safe(F.col(c).cast("string")).alias(c) for c, t in meta.dtypes]
    return meta.select(*flat)


def markdown_rows(meta: DataFrame, text: DataFrame, most: int = 200_000) -> DataFrame:
    """id, body: a Markdown page for each document, the text cut at so many characters."""
    head = F.format_string("# %s\n\n- type: %s\n- language: %s\n- pages: %d\n\n", "name", safe(F.col("doc_type")), safe(F.col("language")), "num_pages")
    return meta.join(text, "id").select("id", F.concat(head, F.substring("text", 1, most)).alias("body"))


WRITERS = {"jsonl": lambda df, path: jsonl_rows(df).select("line").write.text(path), "csv": lambda df, path: csv_rows(df).write.option("header", True).csv(path), "json": lambda df, path: df.write.json(path), "parquet": lambda df, path: df.write.parquet(path)}


def export(meta: DataFrame, kind: str, path: str) -> None:
    """Distributed write in one of WRITERS' formats; another raises ValueError."""
    if kind not in WRITERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(WRITERS)}")
    WRITERS[kind](meta, path)


def note_rows(meta: DataFrame) -> DataFrame:
    """file, body: a Markdown note with front matter for each record; characters that file names can't have become "_"."""
    title = F.regexp_replace(F.regexp_replace(F.coalesce("name", "id"), r'[\\/*?:"<>|]', "_"), r"\.pdf$", "")
    get = lambda c, kind="string": F.col(c) if c in meta.columns else F.lit(None).cast(kind)
    day = lambda c: F.substring(F.coalesce(get(c), F.lit("")), 1, 10)
    line = lambda name, value, keep: F.when(keep, F.concat(F.lit(f"{name}: "), value.cast("string")))
    true = F.lit(True)
    kind, language, number = F.coalesce(F.col("doc_type"), F.lit("documento")), safe(F.col("language")), lambda c: F.coalesce(F.col(c), F.lit(0))
    listed = lambda c, mark: F.when(F.size(F.coalesce(get(c, "array<string>"), F.array().cast("array<string>"))) > 0, F.array_join(F.transform(get(c, "array<string>"), lambda x: F.concat(F.lit(f"  - {mark}"), x, F.lit(mark))), "\n")).otherwise(F.lit("  []"))
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), title, F.lit('"')),
        line("doc_type", kind, true),
        line("language", language, language != ""),
        line("num_pages", number("num_pages"), true),
        line("word_count", number("word_count"), true),
        line("indexed_at", day("indexed_at"), day("indexed_at") != ""),
        line("updated_at", day("updated_at"), day("updated_at") != ""),
        line("file_id", F.col("id"), true),
        line("source", safe(F.col("original_path")), true),
        line("ocr_percentage", get("ocr_percentage", "int"), get("ocr_percentage", "int").isNotNull()),
        F.concat(F.lit("tags:\n"), listed("tags", "")),
        F.concat(F.lit("parties:\n"), listed("parties", '"')),
        F.lit("---"),
    )
    part = lambda head, c: F.when(safe(get(c)) != "", F.concat(F.lit(f"\n\n## {head}\n\n"), F.replace(get(c), F.lit('"'), F.lit("'")))).otherwise(F.lit(""))
    shown = lambda c: F.when(c != "", c).otherwise(F.lit("—"))
    table = [("Tipo", shown(safe(F.col("doc_type")))), ("Páginas", number("num_pages").cast("string")), ("Palavras", number("word_count").cast("string")), ("Idioma", shown(language)), ("Indexado em", shown(day("indexed_at")))]
    rows = F.concat_ws("\n", F.lit("## Metadados\n\n| Campo | Valor |\n|-------|-------|"), *[F.concat(F.lit(f"| {k} | "), v, F.lit(" |")) for k, v in table])
    return meta.select(F.concat(title, F.lit(".md")).alias("file"), F.concat(front, part("Assunto", "subject"), part("Sumário", "summary"), F.lit("\n\n"), rows).alias("body"))


def write_index_json(meta: DataFrame, path: str, version: int = 3) -> None:
    """The whole catalog as one JSON document in one file, in the order of ingest: sorted in parallel, streamed by one writer."""
    first = meta.agg(F.min(F.struct("ingest_seq", "id")).alias("m")).first().m
    comma = F.when((F.col("ingest_seq") == (first.ingest_seq if first else -1)) & (F.col("id") == (first.id if first else "")), F.lit("")).otherwise(F.lit(","))
    rows = meta.select(F.lit(1).alias("part"), "ingest_seq", "id", F.concat(comma, F.to_json(F.struct(*meta.columns))).alias("value"))
    spark = meta.sparkSession
    ends = spark.createDataFrame([(0, f'{{"version": {version}, "files": ['), (2, "]}")], "part int, value string").select("part", F.lit(None).cast("long").alias("ingest_seq"), F.lit("").alias("id"), "value")
    rows.withColumn("ingest_seq", F.col("ingest_seq").cast("long")).unionByName(ends).orderBy("part", "ingest_seq", "id").select("value").coalesce(1).write.text(path)


def write_texts(texts: DataFrame, path: str, compress: bool = False) -> None:
    """Texts or pages (file_id, ...) as JSON lines, gzip if asked for."""
    texts.write.option("compression", "gzip" if compress else "none").json(path)


def table_csv_rows(tables: DataFrame) -> DataFrame:
    """page_id, table_index, csv of tables (page_id, table_index, cells): a CSV with a byte order mark for each table; cells with commas, quotes or newlines are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = F.array_join(F.transform("cells", lambda r: F.array_join(F.transform(r, quoted), ",")), "\r\n")
    return tables.select("page_id", "table_index", F.concat(F.lit("﻿"), body, F.lit("\r\n")).alias("csv"))


def table_json_rows(tables: DataFrame) -> DataFrame:
    """page_id, tables: all tables of a page as one JSON array of (table_index, headers, rows)."""
    one = F.struct("table_index", F.try_element_at("cells", F.lit(1)).alias("headers"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("rows"))
    return tables.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("tables"))
