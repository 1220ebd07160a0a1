"""Reports over the catalog: locations, nested search data, metrics, duplicates, alerts, fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import blank_to_null, display_name, strip
from foliant.operators.catalog import effective_type

#: Fixed value: what follows a text that was cut for a report.
CUT_MARK = "\n[… texto truncado para o report …]"


def location_index(meta: DataFrame, docs: int = 10) -> DataFrame:
    """name, doc_count, ids, by (id, ingest_seq, locations, addresses): mentions of each place of three or more characters, and the first docs records.

    A record that lists a place twice counts twice. The first records are ranked before they meet, so a place that most
    documents name isn't gathered."""
    none = F.array().cast("array<string>")
    places = F.concat(F.coalesce("locations", none), F.coalesce("addresses", none))
    named = meta.select("id", "ingest_seq", F.posexplode(places).alias("nth", "raw")).select("id", "ingest_seq", "nth", strip(F.col("raw")).alias("name")).where(F.length("name") >= 3)
    counts = named.groupBy("name").agg(F.count("*").alias("doc_count"))
    order = Window.partitionBy("name").orderBy("ingest_seq", "nth")
    first = named.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= docs)
    lists = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("ids"))
    return counts.join(lists, "name")


def split_locations(places: DataFrame) -> DataFrame:
    """located (boolean), places, mentions of (name, doc_count, lat): the two lists of a map."""
    return places.groupBy(F.col("lat").isNotNull().alias("located")).agg(F.count("*").alias("places"), F.sum("doc_count").alias("mentions"))


def merged_locations(base: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """base (name, doc_count) with those names that it lacks, whatever their case and blanks, and in how many texts (doc_id, text) each occurs, 1 at least.

    names is a list that a person or model has made; each text is scanned once for all of them."""
    spark = base.sparkSession
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    wanted = list({" ".join(n.split()).lower(): n.strip() for n in reversed(names) if n and n.strip()}.values())
    listed = spark.createDataFrame([(n,) for n in wanted], "name string")
    new = listed.withColumn("_k", key(F.col("name"))).join(base.select(key(F.col("name")).alias("_k")).distinct(), "_k", "left_anti").select("name")
    if not wanted:
        return base.select("name", "doc_count")
    hit = F.filter(F.array(*[F.lit(n) for n in wanted]), lambda n: F.contains(F.lower("text"), F.lower(n)))
    counts = texts.select(F.explode(hit).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    added = new.join(counts, "name", "left").select("name", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("doc_count"))
    return base.select("name", F.col("doc_count").cast("long").alias("doc_count")).unionByName(added)


def shortened(text: Column, most: int | None) -> Column:
    return text if not most else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def search_data(meta: DataFrame, pages: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """id, name, doc_type, num_pages, day, text, pages (array of n, text) of each record; texts and pages cut at most characters.

    A record without pages has its text as page 1. A document's own pages are gathered, never those of several."""
    nested = pages.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("n"), shortened(F.col("text"), most).alias("text")))).alias("pages"))
    body = texts.select("id", F.coalesce("text", F.lit("")).alias("_text"))
    whole = F.array(F.struct(F.lit(1).alias("n"), F.col("_text").alias("text")))
    joined = meta.join(body, "id", "left").join(nested, "id", "left")
    return joined.select("id", F.coalesce(blank_to_null(display_name(F.col("name"))), F.lit("?")).alias("name"), effective_type().alias("doc_type"), F.coalesce("num_pages", F.lit(0)).alias("num_pages"), F.substring(F.coalesce("indexed_at", F.lit("")), 1, 10).alias("day"), shortened(F.coalesce("_text", F.lit("")), most).alias("text"), F.coalesce("pages", whole).alias("pages"))


def metrics_lines(counters: DataFrame, summaries: DataFrame, totals: DataFrame) -> DataFrame:
    """line: the text exposition of counters (key, n), summaries (metric, q50, q95, q99, n, total) and totals (key, n). A few rows each."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    parts = [totals.select(F.concat_ws(" ", "key", F.col("n").cast("string")).alias("line")), counters.select(F.concat_ws(" ", "key", F.col("n").cast("string")).alias("line"))]
    for label, column in (("0.5", "q50"), ("0.95", "q95"), ("0.99", "q99")):
        parts.append(summaries.select(F.concat("metric", F.lit(f'{{quantile="{label}"}} '), six(column)).alias("line")))
    parts.append(summaries.select(F.concat("metric", F.lit("_count "), F.col("n").cast("string")).alias("line")))
    parts.append(summaries.select(F.concat("metric", F.lit("_sum "), six("total")).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def missing(meta: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """id, name, what: records without text or without source file, by (id)."""
    lists = [meta.join(have.select("id"), "id", "left_anti").select("id", "name", F.lit(what).alias("what")) for have, what in ((texts, "text"), (sources, "source"))]
    return lists[0].unionByName(lists[1])


def group_members(groups: DataFrame, meta: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """component, id, name: members (node, component) that the catalog still has, of groups with two of them or more."""
    there = groups.join(meta.select(F.col(key).alias("node"), "id", "name"), "node")
    several = there.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2")
    return there.join(several, "component", "left_semi").select("component", "id", "name")


def alerts(results: DataFrame, seen: DataFrame) -> DataFrame:
    """name, new_count of saved searches with results (name, key) that their last run hadn't seen (name, key)."""
    fresh = results.select("name", "key").distinct().join(seen.select("name", "key"), ["name", "key"], "left_anti")
    return fresh.groupBy("name").agg(F.count("*").alias("new_count"))


def run_search(saved: DataFrame, name: str, executor: Callable[[str, dict], DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Results of the saved search (name, query, options, last_seen_ids) by a caller's executor(query, options), and those of them that are new by key."""
    one = saved.where(F.col("name") == name).select("query", "options", "last_seen_ids").first()
    if one is None:
        raise KeyError(f"no saved search {name!r}")
    found = executor(one.query, one.options or {})
    before = saved.where(F.col("name") == name).select(F.explode(F.coalesce("last_seen_ids", F.array().cast("array<string>"))).alias(key))
    return found, found.withColumn(key, F.col(key).cast("string")).join(before, key, "left_anti")


def fingerprint(meta: DataFrame) -> DataFrame:
    """hash: one hash of all records' id, updated_at and indexed_at, whatever their order: sums of hashes, then a hash of the sum."""
    record = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) if c in meta.columns else F.lit("") for c in ("id", "updated_at", "indexed_at")])
    part = F.conv(F.substring(F.sha2(record, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return meta.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).alias("s")).select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("hash"))


def overview(meta: DataFrame, large: int = 100) -> DataFrame:
    """One row of a report's figures, in one pass but for the groups of copies: records, types, languages, years, the share of pages read
    from pictures, records of so many pages, records without words, groups of copies and the records in them."""
    pages = F.coalesce("num_pages", F.lit(0))
    facts = meta.agg(
        F.count("*").alias("n_docs"),
        F.count_distinct(effective_type()).alias("n_types"),
        F.count_distinct("language").alias("n_languages"),
        F.count_distinct(F.substring("indexed_at", 1, 4)).alias("n_years"),
        F.round(100 * F.sum(F.coalesce("ocr_percentage", F.lit(0)) * pages) / (100 * F.sum(pages)), 4).alias("ocr_share"),
        F.count_if(pages >= large).alias("large"),
        F.count_if(F.coalesce("word_count", F.lit(0)) == 0).alias("wordless"),
    )
    copies = meta.where(F.coalesce("content_hash", F.lit("")) != "").groupBy("content_hash").agg(F.count("*").alias("n")).where("n >= 2")
    return facts.crossJoin(F.broadcast(copies.agg(F.count("*").alias("copy_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))))  # one row each


def newest_deleted(dead: DataFrame) -> DataFrame:
    """dead (file_id, deleted_iso), the last deleted first."""
    return dead.orderBy(F.desc("deleted_iso"), "file_id")


def details(found: DataFrame) -> DataFrame:
    """A record as a person reads it: defaults for what is absent, the day of indexing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    return found.select("id", text("name"), effective_type().alias("doc_type"), text("language"), text("num_pages"), text("word_count"), F.substring(F.coalesce("indexed_at", F.lit("—")), 1, 10).alias("indexed_at"), text("original_path"))


def page_differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, additions, deletions, identical, unified of texts aligned by key (a document's pages: page): a page that one side lacks is empty there."""
    from foliant.operators.records import unified_diff

    both = a.select(*key, F.col("text").alias("a")).join(b.select(*key, F.col("text").alias("b")), key, "full_outer")
    return unified_diff(both).select(*key, "additions", "deletions", "identical", "unified")
