"""Aggregates: dashboards, words, timelines, contracts, graphs, gazetteer, metrics, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.entities import party_type
from foliant.functions.gazetteer import PLACES
from foliant.functions.text import bigrams, countable, stat_tokens
from foliant.operators.catalog import effective_type
from foliant.storage import stored


def quantiles(df: DataFrame, value: str, qs: list[float], group: list[str] | None = None) -> DataFrame:
    """(group columns), q, value: the value at index floor(n * q) of the sorted ones, not interpolated (q 0.5: the upper median).

    Equal values are counted first. The counts are dealt by ranges of (group, value), so that a group that holds most rows
    is spread over tasks; only one sum for each range and group is added up in order. Nulls don't count."""
    group = group or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    counts, _ = stored(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "value-counts")
    key = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]
    ahead = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_part", *group).agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).withColumn("_total", F.sum("_sum").over(Window.partitionBy(*key)))
    within = Window.partitionBy("_part", *key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("_upto", F.sum("_n").over(within)).alias("c")
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    on = F.col("c._part") == F.col("s._part")
    for s in same:
        on = on & s
    joined = run.join(F.broadcast(sums.alias("s")), on).select(*[F.col(f"c.{g}").alias(g) for g in group], F.col(f"c.{value}").alias(value), "c._n", (F.col("_before") + F.col("_upto")).alias("_upto"), "_total")
    asked = joined.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    place = F.least(F.floor(F.col("_total") * F.col("q")), F.col("_total") - 1)
    return asked.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select(*group, "q", value)


def exact_sum(value: Column) -> Column:
    """Sum of a column of doubles that is the same in any order of rows: their decimals, 18 places, are added and rounded once.

    Where one isn't finite or the decimals don't fit (1e20), the doubles are added."""
    decimal = value.try_cast("decimal(38,18)")
    return F.when(F.count(decimal) == F.count(value), F.coalesce(F.try_sum(decimal).cast("double"), F.sum(value))).otherwise(F.sum(value))


def dashboard(meta: DataFrame) -> DataFrame:
    """One row of totals, in one pass: averages rounded down, weighted OCR share, alert counts."""
    pages = F.coalesce("num_pages", F.lit(0))
    weight = F.when(F.col("ocr_percentage").isNotNull() & (pages > 0), pages)
    return meta.agg(
        F.count("*").alias("n_docs"),
        F.sum(pages).cast("long").alias("total_pages"),
        F.sum("file_size").cast("long").alias("total_size"),
        F.sum("word_count").cast("long").alias("total_words"),
        F.floor(F.sum("file_size") / F.count("*")).cast("long").alias("avg_size"),
        (F.sum(F.col("ocr_percentage") * weight) / F.sum(weight)).alias("weighted_ocr"),
        F.avg("ocr_avg_confidence").alias("avg_confidence"),
        F.count_if((F.col("ocr_avg_confidence") >= 0) & (F.col("ocr_avg_confidence") < 70)).alias("low_ocr"),
        F.count_if((F.col("word_count") == 0) & (pages > 0)).alias("empty_text"),
        F.max(F.substring("indexed_at", 1, 10)).alias("latest"),
    )


def by_type(meta: DataFrame) -> DataFrame:
    return meta.groupBy(effective_type().alias("doc_type")).agg(F.count("*").alias("n"), F.sum("num_pages").cast("long").alias("pages"))


def per_day(meta: DataFrame, last: int = 90) -> DataFrame:
    """Counts of the last so many days that have any."""
    days = meta.groupBy(F.substring("indexed_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    return days.where("day <> ''").orderBy(F.desc("day")).limit(last)


def size_histogram(meta: DataFrame, edges: list[int]) -> DataFrame:
    """bucket (how many edges the size reaches), n."""
    return meta.groupBy(sum((F.when(F.col("file_size") >= e, 1).otherwise(0) for e in edges), F.lit(0)).alias("bucket")).agg(F.count("*").alias("n"))


def top_words(texts: DataFrame, stop: list[str], n: int = 50, least: int = 2) -> DataFrame:
    """The n most frequent words; stop words and numbers go after counting, once a word instead of once a token."""
    words = texts.select(F.explode(countable(F.col("text"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~F.col("word").isin(stop) & ~F.col("word").rlike("^[0-9]+$"))
    return counted.orderBy(F.desc("n"), "word").limit(n)


def top_bigrams(texts: DataFrame, stop: list[str], n: int = 30) -> DataFrame:
    """Neighbours after stop words are gone."""
    pairs = texts.select(F.explode(bigrams(stat_tokens(F.col("text"), stop))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(n)


def timeline(meta: DataFrame) -> DataFrame:
    """id, date_iso, source, confidence: a PDF date (1.0), else the first usable content date of five (0.8), else the day of indexing (0.5).

    From (id, ingest_seq, pdf_date, content_dates, indexed_at); the first record of an id counts."""
    first = meta.groupBy("id").agg(F.min_by(F.struct("ingest_seq", "pdf_date", "content_dates", "indexed_at"), "ingest_seq").alias("r")).select("id", "r.*")
    content = F.try_element_at(F.filter(F.slice("content_dates", 1, 5), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(1))
    best = F.coalesce(*[F.when(c.isNotNull() & (c != ""), F.struct(c.alias("date_iso"), F.lit(s).alias("source"), F.lit(w).alias("confidence"))) for c, s, w in ((F.col("pdf_date"), "metadata", 1.0), (content, "content", 0.8), (F.substring("indexed_at", 1, 10), "indexed", 0.5))])
    return first.select("id", "ingest_seq", best.alias("b")).where("b is not null").select("id", "ingest_seq", "b.*")


def by_year(meta: DataFrame) -> DataFrame:
    """year, name, nth: records by their date within each year of indexing."""
    year = F.substring("indexed_at", 1, 4)
    return meta.select(year.alias("year"), "name", F.row_number().over(Window.partitionBy(year).orderBy("indexed_at", "name")).alias("nth"))


def timeline_stats(entries: DataFrame) -> DataFrame:
    year = F.substring("date_iso", 1, 4).cast("int")
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.8).alias("precise"), (F.max(year) - F.min(year)).alias("span_years"), F.min("date_iso").alias("oldest"), F.max("date_iso").alias("newest"))


def expiring(contracts: DataFrame, today: str, days: int = 30) -> DataFrame:
    """id, end_date, days_left, severity of contracts that end within so many days or have ended."""
    left = F.datediff(F.try_to_date("end_date"), F.lit(today).cast("date"))
    severity = F.when(left < 0, "expired").when(left <= 7, "critical").when(left <= 30, "warning").otherwise("notice")
    return contracts.select("id", "end_date", left.alias("days_left"), severity.alias("severity")).where(F.col("days_left") <= days)


def contract_summary(contracts: DataFrame, today: str) -> DataFrame:
    left = F.datediff(F.try_to_date("end_date"), F.lit(today).cast("date"))
    return contracts.agg(F.count("*").alias("total"), F.count_if(left < 0).alias("expired"), F.count_if(left.between(0, 30)).alias("within_30"), F.count_if(left.between(31, 90)).alias("within_90"), F.count_if(left.isNull()).alias("no_date"))


def graph_edges(mentions: DataFrame) -> DataFrame:
    """source < target, weight: entities that occur in the same document, by mentions (doc, entity).

    A document's pairs are made from its own array, one entity at a time, so that no row holds all of them."""
    one = mentions.groupBy("doc").agg(F.collect_set("entity").alias("e"))
    sides = one.select("e", F.explode("e").alias("source")).select("source", F.explode(F.filter("e", lambda b: b > F.col("source"))).alias("target"))
    return sides.groupBy("source", "target").agg(F.count("*").alias("weight"))


def document_edges(mentions: DataFrame) -> DataFrame:
    """source (doc: and the document), target, weight: an edge from each document to each of its entities."""
    return mentions.where("entity is not null").groupBy(F.concat(F.lit("doc:"), F.col("doc").cast("string")).alias("source"), F.col("entity").alias("target")).agg(F.count("*").alias("weight"))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """entity, type, doc_count."""
    return mentions.groupBy("entity").agg(F.count_distinct("doc").alias("doc_count")).select("entity", party_type(F.col("entity")).alias("type"), "doc_count")


def without_dangling(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """edges (source, target, weight) both of whose ends are among nodes (entity, type), of the given types if any."""
    n = (nodes.where(F.col("type").isin(types)) if types else nodes).select("entity")
    return edges.join(n.withColumnRenamed("entity", "source"), "source", "left_semi").join(n.withColumnRenamed("entity", "target"), "target", "left_semi").select("source", "target", "weight")


def place_mentions(texts: DataFrame, places: list[tuple] = PLACES) -> DataFrame:
    """name, n_docs: documents that mention a place as a whole phrase in any case. One scan with a pattern for each place."""
    phrase = lambda name: r"\s+".join(rf"\Q{w}\E" for w in name.split())
    # a look for the first word in lower case spares most texts the pattern
    begins = lambda name: F.contains("low", F.lit(name.split()[0].lower()))
    hit = [F.when(begins(name) & F.col("text").rlike(rf"(?iuU)(?<!\w){phrase(name)}(?!\w)"), F.lit(name)) for name in dict.fromkeys(p[0] for p in places)]
    return texts.select("doc_id", "text", F.lower("text").alias("low")).select("doc_id", F.explode(F.array_compact(F.array(*hit))).alias("name")).groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"))


def located(rows: DataFrame, name: str, places: list[tuple] = PLACES) -> DataFrame:
    """rows with the gazetteer's name, kind, lat, lon for those whose column name is one of its places, whatever its case and blanks."""
    first = {p[0]: p for p in reversed(places)}
    known = rows.sparkSession.createDataFrame(list(first.values()), "name string, kind string, lat double, lon double")
    same = F.lower(F.regexp_replace(F.trim(F.col(name)), r"\s+", " "))
    return rows.withColumn("_key", same).join(F.broadcast(known.withColumn("_key", F.lower("name"))), "_key").drop("_key")  # a few hundred rows


def fresh(results: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Alert rows: results whose key was not seen in the last run."""
    return results.join(seen, key, "left_anti")


def limited(events: DataFrame, who: str, at: str, most: int, seconds: int = 60) -> DataFrame:
    """events with recent (see rate) and accepted: a user's requests beyond most in the window are rejected; rejected ones count too."""
    return rate(events, who, at, seconds).withColumn("accepted", F.col("recent") <= most)


def rate(events: DataFrame, who: str, at: str, seconds: int = 60) -> DataFrame:
    """events with how many of the same user fell into the trailing window, this one included."""
    w = Window.partitionBy(who).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))
