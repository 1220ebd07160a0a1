"""Queries over reports, semantic search, store writes and further rules, by inventory number, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, dates, forensics, signatures, text
from foliant.operators import analytics, catalog, fulltext, ingest, records, reports, semantic, similar
from foliant.plans.archive import CAT, COS, FTS, PAGE, cat, docs, pages, postings_index, query, search, store, vecs
from foliant.sources import pdf, pdf_writer, readers, writers
from foliant.sources.readers import file_id, table
from foliant.storage import scratch_path
from foliant.streaming import flows

ID = "substr(sha256(cast(doc_id as varchar)), 1, 16)"
NOW = "2025-06-01T00:00:00Z"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(file_id(F.col("doc_id")).alias("id"), "text")


# Store writes

@query("b2_b3_versions", CAT + " select id, name, cast([3, 4, 5] as varchar) as versions from cat where ingest_seq % 5 = 4")
def b2(s, d):
    kept = store(s, d)
    name = f"versions-{len(kept.versions('catalog'))}"
    small = cat(s, d).select("id", "name", "ingest_seq")
    start = kept.versions(name)
    for n in range(5):
        kept.replace(name, small.where(F.col("ingest_seq") % 5 == n), keep=3)
    shown = [v - (start[-1] if start else 0) for v in kept.versions(name)]
    return kept.read(name).select("id", "name", F.lit(str(shown)).alias("versions"))


@query("b4_texts_written", "select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def b4(s, d):
    path = scratch_path(s, "texts")
    writers.write_texts(docs(s, d).select("doc_id", "text"), path, compress=True)
    back = s.read.schema("doc_id long, text string").json(path)
    return back.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


query("b8_update_subject", CAT + " select id, case when ingest_seq % 4 = 1 then 'new subject' else name end as subject, name as title from cat")(lambda s, d: catalog.with_subject(cat(s, d).withColumn("metadata", F.struct(F.col("name").alias("title"), F.col("name").alias("subject"))), cat(s, d).where("ingest_seq % 4 = 1").select("id", F.lit("new subject").alias("subject"))).select("id", "metadata.subject", "metadata.title"))


@query("b11_replaced_postings", PAGE + ", k as (select file_id, unnest(t) as token from tok where ingest_seq % 50 <> 7 union all select distinct file_id, unnest(['new', 'words']) from tok where ingest_seq % 50 = 7) select file_id, count(*) as n, count(distinct token) as words from k group by 1")
def b11(s, d):
    new = pages(s, d).where("ingest_seq % 50 = 7").select("file_id", "ingest_seq").distinct().select("file_id", "ingest_seq", F.explode(F.array(F.struct(F.lit(1).alias("page"), F.lit("New words!").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("  ").alias("text")))).alias("p")).select("file_id", "ingest_seq", "p.*")
    return fulltext.replaced(postings_index(s, d), new).groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("words"))


@query("b16_index_json", CAT + " select ingest_seq, id, name, num_pages from cat")
def b16(s, d):
    path = scratch_path(s, "index-json")
    writers.write_index_json(cat(s, d).select("ingest_seq", "id", "name", "num_pages"), path)
    # one document in one file, read back as a whole
    whole = s.read.option("multiLine", "true").schema("version int, files array<struct<ingest_seq:long,id:string,name:string,num_pages:int>>").json(path)
    return whole.select(F.explode("files").alias("f")).select("f.*")


query(
    "b20_notes",
    CAT
    + " select 'doc-' || ingest_seq || '.md' as file, '---' || chr(10) || 'title: \"doc-' || ingest_seq || '\"' || chr(10) || 'doc_type: ' || coalesce(doc_type, 'documento') || chr(10) || 'language: ' || language || chr(10) || 'num_pages: ' || num_pages || chr(10) || 'word_count: ' || word_count || chr(10) || 'indexed_at: ' || substr(indexed_at, 1, 10) || chr(10) || 'file_id: ' || id || chr(10) || 'source: ' || original_path || chr(10) || coalesce('ocr_percentage: ' || ocr_percentage || chr(10), '') || 'tags:' || chr(10) || '  []' || chr(10) || 'parties:' || chr(10) || '  []' || chr(10) || '---' || chr(10) || chr(10) || '## Metadados' || chr(10) || chr(10) || '| Campo | Valor |' || chr(10) || '|-------|-------|' || chr(10) || '| Tipo | ' || coalesce(doc_type, '—') || ' |' || chr(10) || '| Páginas | ' || num_pages || ' |' || chr(10) || '| Palavras | ' || word_count || ' |' || chr(10) || '| Idioma | ' || language || ' |' || chr(10) || '| Indexado em | ' || substr(indexed_at, 1, 10) || ' |' as body from cat",
)(lambda s, d: writers.note_rows(cat(s, d)))


# Pages of the tables hold no HTML table: each document's record is made one, and a second of one row that is too small

def with_tables(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    html = F.concat(F.lit("<p>x</p><table class='a'><tr><th>id, no</th><th>lang</th></tr>\n<tr>"), cell("doc_id"), cell("lang"), F.lit("</tr></table><TABLE><tr><td>one</td><td>row</td></tr></TABLE>"))
    return docs(spark, sf).where("lang is not null").select(F.col("doc_id").alias("page_id"), html.alias("html"))


query("a10_html_tables", "select doc_id as page_id, 0 as table_index, 2 as n_rows, 2 as n_cols, 'id, no | lang' || chr(10) || doc_id || ' | ' || lang as text from documents where lang is not null")(lambda s, d: readers.html_tables(with_tables(s, d)).drop("cells"))
query("b21_tables_csv", "select doc_id as page_id, 0 as table_index, chr(65279) || '\"id, no\",lang' || chr(13) || chr(10) || doc_id || ',' || lang || chr(13) || chr(10) as csv from documents where lang is not null")(lambda s, d: writers.table_csv_rows(readers.html_tables(with_tables(s, d))))
query("b22_tables_json", """select doc_id as page_id, '[{"table_index":0,"headers":["id, no","lang"],"rows":[["' || doc_id || '","' || lang || '"]]}]' as tables from documents where lang is not null""")(lambda s, d: writers.table_json_rows(readers.html_tables(with_tables(s, d))))
query("i48_tables_text", "select doc_id as page_id, 'id, no | lang' || chr(10) || doc_id || ' | ' || lang || chr(10) || chr(10) || 'one | row' as text from documents where lang is not null")(lambda s, d: readers.html_tables(with_tables(s, d), 1, 1).groupBy("page_id").agg(readers.tables_text(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "text"))), lambda t: t["text"])).alias("text")))
query("i62_page_xml", "select doc_id, coalesce(source, '') || case when source is null then '' else chr(10) end || 'line ' || doc_id as text from documents")(lambda s, d: docs(s, d).select("doc_id", readers.page_xml_text(F.concat(F.lit('<PcGts xmlns="urn:page"><TextRegion>'), F.coalesce(F.concat(F.lit("<TextLine><TextEquiv><Unicode> "), "source", F.lit(" </Unicode></TextEquiv></TextLine>")), F.lit("")), F.lit("<TextLine><TextEquiv><Unicode>line "), "doc_id", F.lit("</Unicode></TextEquiv><TextEquiv><Unicode>other</Unicode></TextEquiv></TextLine></TextRegion></PcGts>"))).alias("text")))

# Feedback, details, listings

FEED = "feed as (select doc_id, case when quality = 1 then 'contrato' else 'ata' end as correct_type from labels)"


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "contrato").otherwise("ata").alias("correct_type"))


query("c22_feedback", f"with {FEED} select * from feed")(feedback)
query("c23_feedback_count", f"with {FEED} select count(*) as n from feed")(lambda s, d: feedback(s, d).agg(F.count("*").alias("n")))
query("b36_cleared_feedback", f"with {FEED} select count(*) as n from feed where false")(lambda s, d: records.cleared(feedback(s, d)).agg(F.count("*").alias("n")))
query("c24_details", CAT + " select id, name, coalesce(doc_type, 'documento') as doc_type, language, cast(num_pages as varchar) as num_pages, cast(word_count as varchar) as word_count, substr(indexed_at, 1, 10) as indexed_at, original_path from cat where contains(name, 'doc-12') order by ingest_seq limit 1")(lambda s, d: reports.details(catalog.find(cat(s, d), "DOC-12")))
query("e26_missing", CAT + " select id, name, 'text' as what from cat where ingest_seq % 11 = 0 union all select id, name, 'source' from cat where ingest_seq % 13 = 0")(lambda s, d: reports.missing(cat(s, d), cat(s, d).where("ingest_seq % 11 <> 0"), cat(s, d).where("ingest_seq % 13 <> 0")))
query("f10_newest_searches", "select c_name as name, cast(row_number() over (order by c_acctbal desc, c_name) as integer) as rank from customer")(lambda s, d: records.newest_searches(table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("updated_at"))).select("name", "rank"))
query("f11_newest_deleted", CAT + " select id as file_id, indexed_at as deleted_iso from cat where ingest_seq % 10 = 0 order by indexed_at desc, id limit 20")(lambda s, d: reports.newest_deleted(cat(s, d).where("ingest_seq % 10 = 0").select(F.col("id").alias("file_id"), F.col("indexed_at").alias("deleted_iso"))).limit(20))
query("f17_first_documents", PAGE + ", h as (" + FTS.format(w="list_contains(t, 'the')") + ") select file_id, min(rank) as first from h group by 1 order by 2 limit 7")(lambda s, d: fulltext.first_documents(search(s, d, "the"), 7))
query("f22_search_hits", PAGE + ", h as (" + FTS.format(w="list_contains(t, 'thing')") + ") select file_id, page, 'text' as kind, rank from h where file_id in (select " + ID + " from documents where lang = 'en') order by rank limit 50")(lambda s, d: fulltext.find_in(catalog.filtered(cat(s, d), language="EN"), postings_index(s, d), texts(s, d), "thing"))
query("f22_search_masks", "with h as (select doc_id, " + ID + " as file_id, unnest(regexp_extract_all(text, '\\b(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\b')) as m from documents where lang = 'en') select file_id, null::integer as page, 'ipv4' as kind, cast(row_number() over (order by doc_id) as integer) as rank from h order by doc_id limit 50")(lambda s, d: fulltext.find_in(catalog.filtered(cat(s, d), language="en"), postings_index(s, d), texts(s, d), "ipv4"))
query("k6_pending_postings", "select " + ID + " as file_id, len(string_split(text, chr(10))) as n from documents where doc_id % 3 = 1")(lambda s, d: fulltext.pending(pages(s, d), postings_index(s, d).where("ingest_seq % 3 <> 1")).groupBy("file_id").agg(F.count("*").alias("n")).join(pages(s, d).where("ingest_seq % 3 = 1").select("file_id").distinct(), "file_id", "left_semi"))

# Reports

LOCS = "m as (select id, ingest_seq, unnest([language || ' land', ' place ' || ingest_seq % 7, 'xy', language || ' land']) as raw, generate_subscripts([1, 2, 3, 4], 1) as nth from cat), l as (select id, ingest_seq, nth, trim(raw) as name from m where length(trim(raw)) >= 3)"


def located(spark: SparkSession, sf: str) -> DataFrame:
    land = F.concat("language", F.lit(" land"))
    return cat(spark, sf).select("id", "ingest_seq", F.array(land, F.concat(F.lit(" place "), F.col("ingest_seq") % 7), F.lit("xy")).alias("locations"), F.array(land).alias("addresses"))


query("e8_locations", CAT + ", " + LOCS + ", r as (select *, row_number() over (partition by name order by ingest_seq, nth) as r from l) select name, count(*) as doc_count, string_agg(case when r <= 10 then id end, ',' order by r) as ids from r group by 1")(lambda s, d: reports.location_index(located(s, d)).select("name", "doc_count", F.array_join("ids", ",").alias("ids")))
query("f19_split_locations", CAT + ", " + LOCS + ", c as (select name, count(*) as n from l group by 1) select contains(name, 'land') as located, count(*) as places, cast(sum(n) as bigint) as mentions from c group by 1")(lambda s, d: reports.split_locations(reports.location_index(located(s, d)).withColumn("lat", F.when(F.contains("name", F.lit("land")), 1.0))))
query("d10_merged_locations", "select n as name, greatest((select count(*) from documents where contains(lower(text), lower(n))), 1) as doc_count from (select unnest(['the', 'nowhere at all']) as n) union all select 'Eau', 5")(lambda s, d: reports.merged_locations(s.createDataFrame([("Eau", 5)], "name string, doc_count long"), docs(s, d), [" the", "EAU ", "nowhere at all", "", "The"]))
query("e12_search_data", CAT + " select id, name, coalesce(doc_type, 'documento') as doc_type, num_pages, substr(indexed_at, 1, 10) as day, case when length(text) > 200 then substr(text, 1, 200) || chr(10) || '[… texto truncado para o report …]' else text end as text, array_to_string(list_transform(string_split(text, chr(10)), lambda p: case when length(p) > 200 then substr(p, 1, 200) || chr(10) || '[… texto truncado para o report …]' else p end), '|') as pages from cat join documents on ingest_seq = doc_id")(lambda s, d: reports.search_data(cat(s, d), pages(s, d), texts(s, d), 200).withColumn("pages", F.array_join(F.transform("pages", lambda p: p["text"]), "|")))


@query(
    "e20_metrics",
    "with v as (select event_type as t, list_sort(list(value)) as v, count(value) as n, sum(value) as total from events where value is not null group by 1) "
    "select 'documents_total ' || count(*) as line from documents union all select 'requests_total{endpoint=\"' || event_type || '\"} ' || count(*) from events group by event_type "
    "union all select t || '{quantile=\"' || q[1] || '\"} ' || format('{:.6f}', v[cast(floor(n * cast(q[1] as double)) as bigint) + 1]) from v, (select unnest([['0.5'], ['0.95'], ['0.99']]) as q) "
    "union all select t || '_count ' || n from v union all select t || '_sum ' || format('{:.6f}', round(total, 6)) from v",
)
def e20(s, d):
    events = table(s, d, "events")
    counters = events.groupBy(F.concat(F.lit('requests_total{endpoint="'), "event_type", F.lit('"}')).alias("key")).agg(F.count("*").alias("n"))
    q = analytics.quantiles(events, "value", [0.5, 0.95, 0.99], ["event_type"]).groupBy("event_type").agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(c) for x, c in ((0.5, "q50"), (0.95, "q95"), (0.99, "q99"))])
    sums = events.where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(analytics.exact_sum(F.col("value")), 6).alias("total"))
    totals = docs(s, d).agg(F.lit("documents_total").alias("key"), F.count("*").alias("n"))
    return reports.metrics_lines(counters, q.join(sums, "event_type").withColumnRenamed("event_type", "metric"), totals)


query("e11_overview", CAT + ", g as (select count(*) as n from cat group by content_hash having count(*) >= 2) select count(*) as n_docs, count(distinct coalesce(doc_type, 'documento')) as n_types, count(distinct language) as n_languages, count(distinct substr(indexed_at, 1, 4)) as n_years, round(100.0 * sum(coalesce(ocr_percentage, 0) * num_pages) / (100 * sum(num_pages)), 4) as ocr_share, count(*) filter (where num_pages >= 10) as large, count(*) filter (where word_count = 0) as wordless, (select count(*) from g) as copy_groups, (select cast(coalesce(sum(n), 0) as bigint) from g) as copies from cat")(lambda s, d: reports.overview(cat(s, d), 10))
query("e24_duplicates", CAT + " select content_hash, name, cast(row_number() over (partition by content_hash order by ingest_seq) as integer) as nth from cat qualify count(*) over (partition by content_hash) >= 2")(lambda s, d: similar.listed_groups(cat(s, d)))
GROUPS = f"with recursive {COS}, p as (select x.id as a, y.id as b from n x join n y on x.id <> y.id where list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.35), r as (select a as node, a as seen from p union select node, b from r join p on seen = a), g as (select node, min(seen) as component from r group by node), m as (select g.*, {ID} as id, 'doc-' || doc_id || '.pdf' as name from g join documents on node = doc_id)"
query("d15_similar_documents", GROUPS + " select component, id, name from m qualify count(*) over (partition by component) >= 2")(lambda s, d: reports.group_members(similar.components(similar.similar_pairs(vecs(s, d), 0.35)), cat(s, d)))
query("d14_alerts", "select event_type as name, count(*) as new_count from events where event_id % 4 <> 0 and event_type <> 'view' group by 1")(lambda s, d: reports.alerts(table(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("key")), table(s, d, "events").where("event_id % 4 = 0 or event_type = 'view'").select(F.col("event_type").alias("name"), F.col("event_id").alias("key"))))
query("g4_unseen_keys", "select event_id from (select event_id from events where event_type = 'error' except select event_id from events where event_id % 4 = 0)")(lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id").subtract(table(s, d, "events").where("event_id % 4 = 0").select("event_id")))
query("j25_fingerprint", CAT + " select sha256(count(*) || ':' || sum(cast('0x' || substr(sha256(id || '||' || indexed_at), 1, 15) as bigint))) as hash from cat")(lambda s, d: reports.fingerprint(cat(s, d)))
query("f18_by_year", CAT + " select substr(indexed_at, 1, 4) as year, name, cast(row_number() over (partition by substr(indexed_at, 1, 4) order by indexed_at, name) as integer) as nth from cat")(lambda s, d: analytics.by_year(cat(s, d)))
query("f20_shown_edges", "with m as (select distinct doc_id as doc, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) = 5)) as entity from documents) select a.entity as source, b.entity as target, count(*) as weight from m a join m b on a.doc = b.doc and a.entity < b.entity where a.entity < 'm' and b.entity < 'm' group by 1, 2")(lambda s, d: _shown(s, d))


def _shown(s, d):
    from foliant.plans.archive import _mentions

    nodes = analytics.graph_nodes(_mentions(s, d)).where("entity < 'm'")
    return analytics.without_dangling(analytics.graph_edges(_mentions(s, d)), nodes, ["org"])


query("f21_words_shown", "select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')) as word from documents) group by 1 having count(*) >= 2 and not regexp_matches(word, '^[0-9]+$') order by n desc, word limit 12")(lambda s, d: analytics.top_words(docs(s, d), [], 50).orderBy(F.desc("n"), "word").limit(12))

# Semantic search: the table's vectors as pages of documents, four each

CHUNK = f"{COS}, k as (select {ID.replace('doc_id', 'n.id // 4')} as file_id, cast(n.id % 4 + 1 as integer) as page, e, l, n.id from n)"


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(file_id(F.floor(n / 4).cast("long")).alias("file_id"), (n % 4 + 1).cast("int").alias("page"), F.when(n % 2 == 0, "even").otherwise("odd").alias("model"), "embedding", n)


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").where("vec_id = 0").first()
    return list(row.embedding) if row else []


query("a16_page_vectors", f"select {ID.replace('doc_id', 'vec_id // 4')} as file_id, cast(vec_id % 4 + 1 as integer) as page, len(embedding) as size from embeddings where vec_id % 2 = 1 and len(embedding) > 0")(lambda s, d: semantic.chunks_of(chunk_table(s, d), "odd").select("file_id", "page", F.size("embedding").cast("long").alias("size")))
query("f2_best_pages", f"with {CHUNK}, b as (select file_id, page, list_dot_product(k.e, q.e) / (k.l * q.l) as s from k, n q where q.id = 0), t as (select file_id, page, s from b qualify row_number() over (partition by file_id order by s desc, page) = 1), c as (select t.*, 'doc-' || doc_id || '.pdf' as name from t join documents on file_id = {ID} where doc_id % 4 <> 2) select file_id, name, page, round_even(s, 6) as score, cast(row_number() over (order by round_even(s, 6) desc, file_id) as integer) as rank from c order by score desc, file_id limit 10")(lambda s, d: semantic.search_pages(chunk_table(s, d).select("file_id", "page", "embedding"), cat(s, d).where("ingest_seq % 4 <> 2"), first_vector(s, d)))
query("f3_filtered_documents", f"with {COS}, t as (select {ID} as file_id, 'doc-' || doc_id || '.pdf' as name, list_dot_product(x.e, q.e) / (x.l * q.l) as s from n x join documents on doc_id = x.id, n q where q.id = 0 and lang = 'en' and cast(cast(date '2024-01-01' + cast(doc_id % 120 as integer) as date) as varchar) >= '2024-02-01') select file_id, name, round_even(s, 6) as score, cast(row_number() over (order by round_even(s, 6) desc, file_id desc) as integer) as rank from t order by score desc, file_id desc limit 10")(lambda s, d: semantic.search_documents(table(s, d, "embeddings").select(file_id(F.col("vec_id")).alias("file_id"), "embedding"), cat(s, d), first_vector(s, d), language="EN", date_from="2024-02-01"))
query("b14_lacking_vectors", f"select {ID} as file_id from documents where doc_id not in (select vec_id from embeddings where label = 1)")(lambda s, d: semantic.lacking(docs(s, d).select(file_id(F.col("doc_id")).alias("file_id")), table(s, d, "embeddings").where("label = 1").select(file_id(F.col("vec_id")).alias("file_id"), F.lit("m").alias("model")), "m"))


@query("b32_upserted_vectors", f"select {ID.replace('doc_id', 'vec_id')} as file_id, case when vec_id % 5 = 0 then 0 else len(embedding) end as size from embeddings")
def b32(s, d):
    old = table(s, d, "embeddings").select(file_id(F.col("vec_id")).alias("file_id"), F.lit("m").alias("model"), "embedding", "vec_id")
    new = old.where("vec_id % 5 = 0").withColumn("embedding", F.array().cast("array<float>"))
    return semantic.upserted(old, new).select("file_id", F.size("embedding").cast("long").alias("size"))


query("i9_i10_vector_bytes", "select vec_id, 4 * len(embedding) as n_bytes, embedding[1] as first, true as same, true as refused from embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", "embedding", semantic.packed(F.col("embedding")).alias("b")).select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.col("embedding")[0].alias("first"), (semantic.unpacked(F.col("b")) == F.col("embedding")).alias("same"), semantic.unpacked(F.substring("b", 1, 7)).isNull().alias("refused")))
query("l7_embedded", "select doc_id, 64 as size from documents where trim(text) <> ''")(lambda s, d: docs(s, d).select("doc_id", semantic.embedded(F.col("text"), semantic.hashed_words()).alias("v")).where("v is not null").select("doc_id", F.size("v").alias("size")))

# Rules

HINTS = "(['Edital-1.pdf', 'meu CONTRATO.pdf', 'danfe.pdf', 'recibo.pdf', 'procuração.pdf', 'peticao.pdf', 'privacidade.pdf', 'Report.pdf', 'livro.pdf', 'ata.pdf', 'a very long name of a catalogue of data.pdf', 'x.pdf'])[doc_id % 12 + 1]"
NAMES = ["Edital-1.pdf", "meu CONTRATO.pdf", "danfe.pdf", "recibo.pdf", "procuração.pdf", "peticao.pdf", "privacidade.pdf", "Report.pdf", "livro.pdf", "ata.pdf", "a very long name of a catalogue of data.pdf", "x.pdf"]
named = lambda: F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 12 + 1).cast("int"))
query("i29_type_by_name", "select doc_id, (['edital', 'contrato', 'nota_fiscal', 'recibo', 'procuração', 'petição', 'política', 'relatório', 'registro', 'ata', null, null])[doc_id % 12 + 1] as label from documents")(lambda s, d: docs(s, d).select("doc_id", classify.type_by_name(named()).alias("label")))
query("i30_metadata_hint", "select doc_id, 'title: ' || lang || case when trim(source) <> '' then ' | keywords: ' || trim(source) else '' end as hint from documents where lang is not null")(lambda s, d: docs(s, d).where("lang is not null").select("doc_id", classify.metadata_hint(F.concat(F.lit(" "), "lang"), F.lit("  "), F.col("source")).alias("hint")))
query("i57_ocr_text", r"select doc_id, case when trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' then trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) else coalesce(t, '') end as t from (select doc_id, replace(text, '. ', '.' || chr(9) || '  ' || chr(10) || chr(10) || chr(10) || chr(10)) as t from documents)")(lambda s, d: docs(s, d).select("doc_id", text.normalize_ocr(F.replace("text", F.lit(". "), F.lit(".\t  \n\n\n\n"))).alias("t")))
query("j10_iso_parts", "select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y') end as iso from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", dates.partial_iso(F.year("o_orderdate"), F.when(F.col("o_orderkey") % 3 < 2, F.month("o_orderdate")), F.when(F.col("o_orderkey") % 3 == 0, F.dayofmonth("o_orderdate"))).alias("iso")))
query("g6_normalized_dates", "select event_id, strftime(ts, '%Y-%m-%d') as dates from events")(lambda s, d: table(s, d, "events").select("event_id", F.array_join(dates.normalized_dates(F.array(F.lit("nothing"), F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "'D:'yyyyMMdd"), F.date_format("ts", "yyyy-MM-dd"))), ",").alias("dates")))
query("j5_pdf_date", "select event_id, case when event_id % 5 = 0 then null else strftime(ts, '%Y-%m-%d') end as parsed from events")(lambda s, d: table(s, d, "events").select("event_id", dates.pdf_date(F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "'D:'yyyy'1399'")).otherwise(F.date_format("ts", "'D:'yyyyMMddHHmmss"))).alias("parsed")))
query("j11_shown_pdf_dates", "select event_id, case when event_id % 2 = 0 then strftime(ts, '%d/%m/%Y %H:%M') else strftime(ts, '%d/%m/%Y') end as shown from events")(lambda s, d: table(s, d, "events").select("event_id", dates.shown_pdf_date(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "'D:'yyyyMMddHHmmss")).otherwise(F.date_format("ts", "'D:'yyyyMMdd"))).alias("shown")))
query("j13_xmp_dates", "select event_id, strftime(ts - interval 2 hour, '%Y-%m-%d %H:%M:%S') as utc from events")(lambda s, d: table(s, d, "events").select("event_id", F.date_format(forensics.xmp_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))), "yyyy-MM-dd HH:mm:ss").alias("utc")))
query("j4_months", "select l_orderkey, l_linenumber, (case l_linenumber % 3 when 0 then q * 12 when 1 then greatest(q // 30, 1) else q end)::integer as months from (select *, cast(l_quantity as integer) as q from lineitem)")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", dates.months(F.col("l_quantity").cast("int"), F.element_at(F.array(F.lit("anos"), F.lit("dias"), F.lit("meses")), F.col("l_linenumber") % 3 + 1)).cast("int").alias("months")))
query("i6_agreement", "select doc_id, ((doc_id % 2 = doc_id % 3)::int + (doc_id % 5 = 0)::int) / 2.0::double as share from documents")(lambda s, d: docs(s, d).select("doc_id", signatures.agreement(F.array(F.col("doc_id") % 2, F.col("doc_id") % 5), F.array(F.col("doc_id") % 3, F.lit(0))).alias("share")))


@query("j23_forensics", "select o_orderkey as id, (case when o_orderkey % 3 = 0 then 40 else 0 end + case when o_orderkey % 7 = 0 then 20 else 0 end + case when o_orderkey % 2 = 0 then 5 else 0 end + case when o_orderkey % 5 = 0 then 5 else 0 end)::integer as score from orders")
def j23(s, d):
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    zone = F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("Z"))
    stamp = lambda c: F.concat(F.date_format(c, "'D:'yyyyMMddHHmmss"), zone)
    changed = F.when(n % 3 == 0, day - F.expr("interval 2 days")).otherwise(day + F.expr("interval 2 hours"))
    odd = n % 7 == 0
    found = forensics.anomalies(stamp(day), stamp(changed), F.when(odd, "Microsoft Word").otherwise("x"), F.when(odd, "GPL Ghostscript 9").otherwise("y"), F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("ana")))
    return table(s, d, "orders").select(n.alias("id"), forensics.risk_score(found).alias("score"))


query("g1_merged_entities", "with b as (select doc_id, string_split(text, ' ') as w from documents where text is not null), c as (select doc_id, w[:3] as base, w[2:60] as more from b), x as (select doc_id, base, trim(unnest(more)) as v, generate_subscripts(more, 1) as i from c), f as (select doc_id, base, lower(v) as k, min(i) as i, arg_min(v, i) as v from x where v <> '' and length(v) <= 200 and not list_contains(list_transform(base, lambda y: lower(y)), lower(v)) group by 1, 2, 3), r as (select *, row_number() over (partition by doc_id order by i) as r from f) select c.doc_id, array_to_string(list_concat(c.base, coalesce(l.v, [])), '|') as merged from c left join (select doc_id, list(v order by i) as v from r where r + len(base) <= 35 group by 1) l on l.doc_id = c.doc_id")(lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.array_join(text.merged(F.slice("w", 1, 3), F.slice("w", 2, 59)), "|").alias("merged")))

# Record tables

SAVED = "saved as (select c_name as name, c_mktsegment as query, 1.0::double as created_at, 1.0::double as updated_at, 2 as seen from customer), new as (select c_name as name, 'changed' as query from customer where c_custkey % 3 = 0 union all select 'new ' || c_custkey, 'added' from customer where c_custkey % 7 = 0)"


def saved(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("query"), F.create_map().cast("map<string,string>").alias("options"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"), F.lit(2.0).alias("last_run_at"), F.array(F.lit("x"), F.lit("y")).alias("last_seen_ids"))


def new_searches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("map<string,string>").alias("options")
    return c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.lit("changed").alias("query"), none).union(c.where("c_custkey % 7 = 0").select(F.concat(F.lit("new "), "c_custkey"), F.lit("added"), none))


shown = lambda df: df.select("name", "query", "created_at", "updated_at", F.size("last_seen_ids").alias("seen"))
query("k10_save_searches", f"with {SAVED} select s.name, coalesce(n.query, s.query) as query, created_at, case when n.name is null then updated_at else 9.0 end as updated_at, case when n.name is null then seen else 0 end as seen from saved s left join new n on n.name = s.name union all select name, query, 9.0, 9.0, 0 from new where query = 'added'")(lambda s, d: shown(records.save_searches(saved(s, d), new_searches(s, d), 9.0)))
query("k10_save_new_searches", f"with {SAVED} select * from saved union all select name, query, 9.0, 9.0, 0 from new where query = 'added'")(lambda s, d: shown(records.save_searches(saved(s, d), new_searches(s, d), 9.0, overwrite=False)))
query("k11_saved_search", f"with {SAVED} select * from saved where name = (select min(c_name) from customer)")(lambda s, d: shown(saved(s, d).join(table(s, d, "customer").agg(F.min("c_name").alias("name")), "name", "left_semi")))
query("k12_delete_search", f"with {SAVED} select * from saved where name not in (select name from new)")(lambda s, d: shown(records.without_searches(saved(s, d), new_searches(s, d))))
query("k15_k16_grants", "with l as (select user_id, event_type, arg_max(coalesce(value > 50, false), event_id) as g from events group by 1, 2) select cast(user_id as varchar) as \"user\", coalesce(string_agg(case when g then event_type end, ',' order by event_type), '') as allowed, coalesce(string_agg(case when not g then event_type end, ',' order by event_type), '') as deny from l where user_id is not null group by 1")(lambda s, d: records.changed_grants(s.createDataFrame([], "user string, allowed array<string>, deny array<string>"), table(s, d, "events").where("user_id is not null").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("file_id"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("granted"))).select("user", F.array_join("allowed", ",").alias("allowed"), F.array_join("deny", ",").alias("deny")))


def versions(spark: SparkSession, sf: str, odd: int) -> DataFrame:
    """Pages of documents of odd or even numbers, two by two the versions of one."""
    return pages(spark, sf).where(F.col("ingest_seq") % 2 == odd).select(F.floor(F.col("ingest_seq") / 2).alias("pair"), "page", "text")


query("d16_i40_page_differences")(lambda s, d: reports.page_differences(versions(s, d, 0), versions(s, d, 1), ["pair", "page"]))
query("k1_changed_files", "select cast(doc_id as varchar) as path from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0 and (doc_id % 3 = 0 or doc_id % 4 = 0)")(lambda s, d: _changed(s, d))


def _changed(s, d):
    n, path = F.col("doc_id"), F.col("doc_id").cast("string").alias("path")
    time = lambda day: F.lit(f"2025-01-{day:02d}").cast("timestamp").alias("modificationTime")
    now = docs(s, d).select(path, time(2), n.alias("length"), n)
    # every fifth is still growing, every seventh is new to the listing; of a third nothing is done, a fourth was done when it was older
    before = now.where("doc_id % 7 <> 0").select("path", F.when(n % 5 == 0, n - 1).otherwise(n).alias("length"))
    done = docs(s, d).where("doc_id % 3 <> 0 or doc_id % 4 = 0").select(path, F.when(n % 4 == 0, time(1)).otherwise(time(2)).alias("modificationTime"))
    return flows.changed_files(now.drop("doc_id"), before, done)[0].select("path")


query("k3_rejections", "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) <= 2 as accepted from events")(lambda s, d: analytics.limited(table(s, d, "events"), "user_id", "ts", 2, 3600).select("event_id", "accepted"))


@query("k18_read_log", "select \"user\", count(*) as n, count(*) filter (where allowed) as allowed, max(iso) as last from (select cast(user_id as varchar) as \"user\", event_id % 3 <> 0 as allowed, strftime(to_timestamp(1700000000 + event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso from events where user_id is not null) group by 1")
def k18(s, d):
    path = scratch_path(s, "read-log")
    reads = table(s, d, "events").where("user_id is not null").select((F.lit(1700000000) + F.col("event_id")).cast("double").alias("ts"), F.col("user_id").cast("string").alias("user"), F.lit("f").alias("file_id"), (F.col("event_id") % 3 != 0).alias("allowed"), F.lit("").alias("ip"), F.lit("/text").alias("endpoint"))
    for half in (0, 1):
        flows.append_reads(path, reads.where(F.col("ts").cast("long") % 2 == half))
    back = s.read.schema("user string, allowed boolean, iso string").json(path)
    return back.groupBy("user").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.max("iso").alias("last"))


def _detectors():
    def first_word(t):
        return t.split()[0]

    def fails(t):
        raise ValueError("no model")

    return {"a": first_word, "b": fails}


query("k19_detectors", r"select doc_id, case when len(w) > 0 then w[1] end as word, case when len(w) = 0 then 'IndexError: list index out of range' end as word_error, 'ValueError: no model' as other_error from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]+') as w from documents)")(lambda s, d: flows.detected(docs(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", _detectors()).select("doc_id", F.col("a.value").alias("word"), F.col("a.error").alias("word_error"), F.col("b.error").alias("other_error")))


# Ingest plans: files are the documents' texts. A third is known, of a third the record has an old path, the last has a record
# of other content at every tenth path, else none; copies have one status for the first path

FILES = "f as (select cast(doc_id as varchar) as path, doc_id, substr(sha256(coalesce(text, '')), 1, 32) as h, min(cast(doc_id as varchar)) over (partition by coalesce(text, '')) as first from documents), m as (select case doc_id % 3 when 0 then path when 1 then 'old/' || path else path end as path, case when doc_id % 3 = 2 then 'x' else h end as h from f where doc_id % 3 < 2 or doc_id % 10 = 2), k as (select m.h, bool_or(f.path is not null) as there from m left join f on f.path = m.path group by 1)"


@query("a1_k4_ingest_plan", f"with {FILES} select f.path, case when m.h = f.h then 'known' when coalesce(k.there, false) or f.path <> f.first then 'duplicate' when k.there is not null then 'moved' when m.h is not null then 'changed' else 'new' end as status from f left join m on m.path = f.path left join k on k.h = f.h")
def a1(s, d):
    return ingest.planned(*_files_and_records(s, d)).select("path", "status")


@query("k4_relocated", f"with {FILES} select m.path as before, case when k.there is false and f.first is not null then f.first else m.path end as after from m join k on k.h = m.h left join (select distinct h, first from f) f on f.h = m.h")
def k4(s, d):
    files, meta = _files_and_records(s, d)
    return ingest.relocated(meta.withColumn("before", F.col("original_path")), ingest.planned(files, meta)).select("before", F.col("original_path").alias("after"))


def _files_and_records(s, d):
    n = F.col("doc_id")
    files = docs(s, d).select(n.cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), n)
    old = files.where("doc_id % 3 < 2 or doc_id % 10 = 2")
    meta = old.select(F.when(n % 3 == 1, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("original_path"), F.col("path").alias("name"), F.when(n % 3 == 2, F.lit("x")).otherwise(readers.content_hash(F.col("content"))).alias("content_hash"))
    return files.drop("doc_id"), meta


@query("k5_failed_files", "select cast(doc_id as varchar) as path, case when doc_id % 6 = 0 then 'broken' else 'not a pdf' end as status from documents where doc_id % 3 = 0")
def k5(s, d):
    n = F.col("doc_id")
    whole = pdf_writer.pdf(F.array(F.lit("page")), F.lit("t"))
    content = F.when(n % 6 == 0, F.lit("%PDF-1.4 and nothing").cast("binary")).when(n % 3 == 0, F.lit("text").cast("binary")).otherwise(whole)
    return ingest.failures(pdf.read_pdf(docs(s, d).select(n.cast("string").alias("path"), content.alias("content")))).select("path", "status")
