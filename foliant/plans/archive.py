"""Queries over the archive operators, by inventory number, and DuckDB SQL for the same rows.

A query without SQL here is compared with brute force in the tests instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, dates, entities, gazetteer, text
from foliant.operators import analytics, catalog, fulltext, similar
from foliant.sources import readers, writers
from foliant.sources.readers import table
from foliant.storage import Store, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP = gazetteer.stop_words("en")
_STOPS = ", ".join(f"'{w}'" for w in STOP)
TODAY = "2025-06-01"

CAT = r"""with cat as (
  select substr(sha256(cast(doc_id as varchar)), 1, 16) as id, doc_id as ingest_seq, '/archive/' || source || '/doc-' || doc_id || '.pdf' as original_path,
    'doc-' || doc_id || '.pdf' as name, len(string_split(text, chr(10))) as num_pages, (['contrato', 'relatório', null, 'fatura'])[doc_id % 4 + 1] as doc_type,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as word_count, strlen(text) as file_size, substr(sha256(text), 1, 32) as content_hash,
    lang as language, cast(cast(date '2024-01-01' + cast(doc_id % 120 as integer) as date) as varchar) || 'T00:00:00Z' as indexed_at,
    case when doc_id % 3 = 0 then cast(doc_id % 101 as integer) end as ocr_percentage, case when doc_id % 3 = 0 then 40.0 + doc_id % 60 end as ocr_avg_confidence
  from documents)"""
PAGE = """with page as (
  select substr(sha256(cast(doc_id as varchar)), 1, 16) as file_id, doc_id as ingest_seq, generate_subscripts(string_split(text, chr(10)), 1) as page, unnest(string_split(text, chr(10))) as text from documents),
tok as (
  select file_id, ingest_seq, page, list_filter(string_split_regex(translate(lower(text), '{a}', '{p}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as t from page)""".format(a=text.ACCENTED, p=text.PLAIN)

def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_stores: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf: str) -> Store:
    """The application's store of a folder of tables: catalog and postings are written when a query first needs them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        _stores[key] = Store(spark, scratch_path(spark, "store"))
    return _stores[key]


def cat(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf).ensure("catalog", lambda: readers.catalog(docs(spark, sf)))


def postings_index(spark: SparkSession, sf: str) -> DataFrame:
    kept = store(spark, sf)
    if not kept.versions("postings"):
        fulltext.write_index(kept, "postings", pages(spark, sf))
    return kept.read("postings")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return readers.pages(docs(spark, sf))


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


# Scans

query("a11_catalog", CAT + " select * from cat")(lambda s, d: readers.catalog(docs(s, d)))
query("a12_text_lookup", "select text from documents where doc_id = 7")(lambda s, d: docs(s, d).where("doc_id = 7").select("text"))
query("a13_page_lookup", PAGE + " select text from page where ingest_seq = 7 and page = 2")(lambda s, d: readers.page_text(pages(s, d), _id(7), 2))
query("a14_pages", PAGE + " select file_id, ingest_seq, cast(page as integer) as page, text from page")(pages)
query("a15_embeddings", "select vec_id as id, len(embedding) as size, embedding[1] as first from embeddings where label = 1")(lambda s, d: table(s, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("size"), F.col("embedding")[0].alias("first")))
query("a17_audit_tail", "select event_id, event_type from events order by event_id desc limit 100")(lambda s, d: readers.tail(table(s, d, "events"), "event_id", 100).select("event_id", "event_type"))
query("a18_read_log_tail", "select event_id, user_id from (select * from events order by event_id desc limit 50) order by event_id")(lambda s, d: readers.tail(table(s, d, "events"), "event_id", 50, False).select("event_id", "user_id"))
query("a27_hyperlinks", """select page_id, cast(generate_subscripts(h, 1) - 1 as integer) as pos, unnest(h) as href from (select page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) as h from pages)""")(lambda s, d: readers.hyperlinks(table(s, d, "pages")))
query("a31_content_hash", "select doc_id, substr(sha256(text), 1, 32) as hash from documents")(lambda s, d: docs(s, d).select("doc_id", readers.content_hash(F.col("text")).alias("hash")))
query("a33_documents_with_text", CAT + " select id, name, coalesce(doc_type, '') as doc_type, length(text) as n_chars from cat join documents on ingest_seq = doc_id")(lambda s, d: cat(s, d).join(docs(s, d).select(F.col("doc_id").alias("ingest_seq"), "text"), "ingest_seq", "left").select("id", "name", writers.safe(F.col("doc_type")).alias("doc_type"), F.length("text").cast("long").alias("n_chars")))


def _id(n: int) -> str:
    import hashlib

    return hashlib.sha256(str(n).encode()).hexdigest()[:16]


# Writers and mutations

@query("b1_upsert", CAT + " select id, case when ingest_seq % 10 = 0 then 'new-' || ingest_seq else name end as name, indexed_at from cat union all select 'zzz' || ingest_seq, 'added', '2030-01-01' from cat where ingest_seq < 3")
def b1(s, d):
    old = cat(s, d).select("id", "name", "indexed_at", "ingest_seq")
    again = old.where("ingest_seq % 10 = 0").select("id", F.concat(F.lit("new-"), "ingest_seq").alias("name"), F.lit("2030-01-01").alias("indexed_at"), "ingest_seq")
    added = old.where("ingest_seq < 3").select(F.concat(F.lit("zzz"), "ingest_seq").alias("id"), F.lit("added").alias("name"), F.lit("2030-01-01").alias("indexed_at"), "ingest_seq")
    return catalog.upsert(old, again.union(added)).select("id", "name", "indexed_at")


query("b5_remove", CAT + " select id, name from cat where ingest_seq % 7 <> 0")(lambda s, d: catalog.removed(cat(s, d).select("id", "name"), cat(s, d).where("ingest_seq % 7 = 0")))
query("b6_update_type", CAT + " select id, case when ingest_seq = 4 then 'ata' else doc_type end as doc_type from cat")(lambda s, d: cat(s, d).select("id", F.when(F.col("ingest_seq") == 4, "ata").otherwise(F.col("doc_type")).alias("doc_type")))
query("b7_clean_tags", "select doc_id, case when trim(source) <> '' then trim(source) || ',' || lang else lang end as tags from documents")(lambda s, d: docs(s, d).select("doc_id", F.array_join(catalog.clean_tags(F.array(F.concat(F.lit(" "), "source"), F.lit(" "), F.concat("lang", F.lit(" ")))), ",").alias("tags")))


@query("b9_moved", CAT + " select id, case when ingest_seq in (select min(ingest_seq) from cat group by content_hash having count(*) = 1) and ingest_seq % 5 = 0 then '/moved/' || name else original_path end as original_path from cat where content_hash in (select content_hash from cat group by 1 having count(*) = 1)")
def b9(s, d):
    c = cat(s, d)
    single = c.groupBy("content_hash").agg(F.count("*").alias("n")).where("n = 1").select("content_hash")
    c = c.join(single, "content_hash", "left_semi")
    found = c.where("ingest_seq % 5 = 0").select("content_hash", F.concat(F.lit("/moved/"), "name").alias("new_path"), F.col("name").alias("new_name"))
    return catalog.moved(c, found).select("id", "original_path")


query("b10_migrate", CAT + " select id, coalesce(doc_type, 'documento') as doc_type, word_count from cat")(lambda s, d: catalog.migrated(cat(s, d)).select("id", "doc_type", "word_count"))
query("b12_postings", PAGE + " select token, file_id, cast(page as integer) as page, cast(pos - 1 as integer) as pos from (select file_id, page, unnest(t) as token, generate_subscripts(t, 1) as pos from tok)")(lambda s, d: fulltext.postings(pages(s, d)).drop("ingest_seq"))
query("b13_new_postings", PAGE + " select file_id, count(*) as n from (select file_id, ingest_seq, unnest(t) as token from tok) where ingest_seq % 2 = 1 group by 1")(lambda s, d: fulltext.postings(pages(s, d).join(pages(s, d).where("ingest_seq % 2 = 0").select("file_id").distinct(), "file_id", "left_anti")).groupBy("file_id").agg(F.count("*").alias("n")))
query("b15_page_chunks", PAGE + " select file_id, cast(page as integer) as page, length(substr(text, 1, 1500)) as n from page where length(trim(text)) >= 30")(lambda s, d: pages(s, d).where("length(trim(text)) >= 30").select("file_id", "page", F.length(F.substring("text", 1, 1500)).cast("long").alias("n")))
query("b17_export_jsonl", CAT + """ select ingest_seq, '{"id":"' || id || '","name":"' || name || '","doc_type":"' || coalesce(doc_type, '') || '","language":"' || language || '","num_pages":' || num_pages || ',"indexed_at":"' || substr(indexed_at, 1, 10) || '"}' as line from cat""")(lambda s, d: writers.jsonl_rows(cat(s, d)))
query("b18_export_csv", CAT + " select id, name, coalesce(doc_type, '') as doc_type, cast(num_pages as varchar) as num_pages from cat")(lambda s, d: writers.csv_rows(cat(s, d).select("id", "name", "doc_type", "num_pages")))
query("b19_export_markdown", CAT + " select id, '# ' || name || chr(10) || chr(10) || '- type: ' || coalesce(doc_type, '') || chr(10) || '- language: ' || language || chr(10) || '- pages: ' || num_pages || chr(10) || chr(10) || substr(text, 1, 200000) as body from cat join documents on ingest_seq = doc_id")(lambda s, d: writers.markdown_rows(cat(s, d), docs(s, d).select(readers.file_id(F.col("doc_id")).alias("id"), "text")))
query("b24_retention", "select event_id, event_type from events order by event_id desc limit 500")(lambda s, d: catalog.last_rows(table(s, d, "events"), "event_id", 500).select("event_id", "event_type"))

# Filters and projections

query("c1_filter_catalog", CAT + " select id, name from cat where coalesce(doc_type, 'documento') = 'documento' and lower(language) = 'en' and substr(indexed_at, 1, 10) between '2024-01-15' and '2024-03-31'")(lambda s, d: catalog.filtered(cat(s, d), "Documento", "EN", "2024-01-15", "2024-03-31").select("id", "name"))
query("c3_find_by_hash", CAT + " select id from cat where content_hash = (select content_hash from cat where ingest_seq = 11) order by ingest_seq limit 1")(lambda s, d: cat(s, d).join(F.broadcast(cat(s, d).where("ingest_seq = 11").select("content_hash")), "content_hash").orderBy("ingest_seq").limit(1).select("id"))
query("c4_find_by_name", CAT + " select id, name from cat where contains(lower(name), 'oc-12') order by ingest_seq limit 1")(lambda s, d: catalog.find(cat(s, d), "OC-12").select("id", "name"))
query("c11_ipv4_mask", r"select doc_id, array_to_string(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b'), ',') as hits from documents")(lambda s, d: docs(s, d).select("doc_id", F.array_join(entities.mask(F.col("text"), "ipv4"), ",").alias("hits")))
query("c12_id_check", CAT + " select id, regexp_matches(id, '^[a-fA-F0-9]{16}$') as ok from cat")(lambda s, d: cat(s, d).select("id", F.col("id").rlike("^[a-fA-F0-9]{16}$").alias("ok")))
query("c13_corrupt_text", "select doc_id, length(trim(text)) >= 20 and length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{e000}-\\x{f8ff}\\x{fffd}]', '', 'g')) / length(text) > 0.3 as bad from documents")(lambda s, d: docs(s, d).select("doc_id", text.corrupt(F.col("text")).alias("bad")))
query("c14_entropy", "select doc_id, round(-sum(n / total * log2(n / total)), 6) as bits from (select doc_id, ch, count(*) as n, sum(count(*)) over (partition by doc_id) as total from (select doc_id, unnest(string_split(lower(text), '')) as ch from documents) group by 1, 2) group by 1")(lambda s, d: docs(s, d).select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("bits")))
query("c16_readable", CAT + " select id from cat where ingest_seq % 2 = 0 and ingest_seq <> 4 and ingest_seq < 20")(lambda s, d: catalog.readable(cat(s, d).select("id"), s.createDataFrame([("ana", [_id(n) for n in range(0, 20, 2)], [_id(4)])], "user string, allowed array<string>, deny array<string>"), "ana", False))
query("c18_display_name", CAT + " select id, name as shown from cat")(lambda s, d: cat(s, d).select("id", text.display_name(F.col("original_path")).alias("shown")))
query("c20_text_slice", "select doc_id, length(substr(text, 1, 1000)) as n from documents")(lambda s, d: docs(s, d).select("doc_id", F.length(F.substring("text", 1, 1000)).cast("long").alias("n")))
PLACE_ROWS = "(values " + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in {p[0]: p[2:] for p in reversed(gazetteer.PLACES)}.items()) + ") as g(name, lat, lon)"


@query("c21_gazetteer_lookup", f"select c_custkey, g.name, cast(lat as double) as lat from (select c_custkey, (['Minas Gerais', 'Bahia', 'Tokyo', 'nowhere'])[c_custkey % 4 + 1] as q from customer) join {PLACE_ROWS} on lower(q) = lower(g.name)")
def c21(s, d):
    q = F.element_at(F.array(*map(F.lit, [" minas   GERAIS ", "bahia", "TOKYO", "nowhere"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return analytics.located(table(s, d, "customer").select("c_custkey", q.alias("q")), "q").select("c_custkey", "name", "lat")


@query("c6_literal_hits", "select doc_id, (length(text) - length(replace(lower(text), 'the', ''))) // 3 as n, position('the' in lower(text)) - 1 as first from documents where contains(lower(text), 'the')")
def c6(s, d):
    low = F.lower("text")
    return docs(s, d).where(low.contains("the")).select("doc_id", ((F.length("text") - F.length(F.replace(low, F.lit("the"), F.lit("")))) / 3).cast("long").alias("n"), (F.instr(low, "the") - 1).cast("long").alias("first"))


# Joins

FTS = "select file_id, cast(page as integer) as page, cast(row_number() over (order by ingest_seq, page) as integer) as rank from tok where {w} order by ingest_seq, page limit 200"


def search(spark: SparkSession, sf: str, q: str, n: int = 200) -> DataFrame:
    return fulltext.search(postings_index(spark, sf), q, n)


query("f1_search_and", PAGE + " " + FTS.format(w="list_contains(t, 'the') and list_contains(t, 'thing')"))(lambda s, d: search(s, d, "the thing"))
query("f1_search_or_not", PAGE + " " + FTS.format(w="list_contains(t, 'heing') or (list_contains(t, 'thing') and not list_contains(t, 'the'))"))(lambda s, d: search(s, d, "heing OR thing NOT the"))
query("f1_search_phrase", PAGE + " " + FTS.format(w="contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')"))(lambda s, d: search(s, d, '"of the"'))
query("f1_search_folded", PAGE + " " + FTS.format(w="list_contains(t, 'eau')"))(lambda s, d: search(s, d, "éau"))
query("c5_limit_then_type", PAGE + ", " + CAT[5:] + ", h as (" + FTS.format(w="list_contains(t, 'thing')").replace("200", "20") + ") select file_id, h.page from h join cat on id = file_id where doc_type = 'contrato'")(lambda s, d: search(s, d, "thing", 20).join(cat(s, d).where("doc_type = 'contrato'").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", "page"))
query("c17_allowed_hits", PAGE + ", h as (" + FTS.format(w="list_contains(t, 'the')") + ") select file_id, page from (select h.* from h join cat on id = file_id where language = 'en' order by rank limit 50)".replace("join cat on id = file_id where language = 'en'", "where file_id in (select substr(sha256(cast(doc_id as varchar)), 1, 16) from documents where lang = 'en')"))(lambda s, d: search(s, d, "the").join(cat(s, d).where("language = 'en'").select(F.col("id").alias("file_id")), "file_id", "left_semi").orderBy("rank").limit(50).select("file_id", "page"))
query("d1_hits_with_names", PAGE + ", " + CAT[5:] + ", h as (" + FTS.format(w="list_contains(t, 'thing')") + ") select rank, coalesce(name, file_id) as name from h left join cat on id = file_id")(lambda s, d: search(s, d, "thing").join(cat(s, d).select(F.col("id").alias("file_id"), "name"), "file_id", "left").select("rank", F.coalesce("name", "file_id").alias("name")))
query("h4_snippets")(lambda s, d: fulltext.snippets(search(s, d, "thing"), pages(s, d), ["thing"]))


@query("d2_hybrid_rrf", PAGE + ", f as (" + FTS.format(w="list_contains(t, 'the')") + "), s as (" + FTS.format(w="list_contains(t, 'of')") + ") select file_id, page, round(coalesce(1.0 / (60 + f.rank), 0) + coalesce(0.5 / (60 + s.rank), 0), 9) as score from f full join s using (file_id, page)")
def d2(s, d):
    both = [(search(s, d, "the"), 1.0), (search(s, d, "of"), 0.5)]
    return fulltext.fuse(both, ["file_id", "page"]).select("file_id", "page", F.round("score", 9).alias("score"))


COS = "v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), n as (select id, e, sqrt(list_dot_product(e, e)) as l from v)"
query("d3_similar_pairs", f"with {COS} select x.id as a, y.id as b, round_even(list_dot_product(x.e, y.e) / (x.l * y.l), 4) as similarity from n x join n y on x.id < y.id where list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.35")(lambda s, d: similar.similar_pairs(vecs(s, d), 0.35))
query("e3_similar_groups", f"with recursive {COS}, p as (select x.id as a, y.id as b from n x join n y on x.id <> y.id where list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.35), r as (select a as node, a as seen from p union select node, b from r join p on seen = a) select node, min(seen) as component from r group by node")(lambda s, d: similar.components(similar.similar_pairs(vecs(s, d), 0.35)))


@query("f2_nearest", f"with {COS} select x.id, round_even(list_dot_product(x.e, q.e) / (x.l * q.l), 6) as score, cast(row_number() over (order by round_even(list_dot_product(x.e, q.e) / (x.l * q.l), 6) desc, x.id) as integer) as rank from n x, n q where q.id = 0 order by score desc, x.id limit 10")
def f2(s, d):
    first = vecs(s, d).where("id = 0").first()
    return similar.nearest(vecs(s, d), list(first.embedding) if first else [], 10)


# stand-ins for entities: all words of five letters
M = "with m as (select distinct doc_id as doc, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) = 5)) as entity from documents) "
query("d8_graph_edges", M + "select a.entity as source, b.entity as target, count(*) as weight from m a join m b on a.doc = b.doc and a.entity < b.entity group by 1, 2")(lambda s, d: analytics.graph_edges(_mentions(s, d)))
query("d8_document_edges", M + "select 'doc:' || doc as source, entity as target, count(*) as weight from m group by 1, 2")(lambda s, d: analytics.document_edges(_mentions(s, d)))
query("e18_graph_nodes", M + "select entity, 'org' as type, count(*) as doc_count from m group by 1")(lambda s, d: analytics.graph_nodes(_mentions(s, d)))


def _five(text: str):
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) == 5))


def _mentions(s, d):
    return docs(s, d).select(F.col("doc_id").alias("doc"), F.explode(_five("text")).alias("entity"))


@query("d9_places", "select 'Brasil' as name, count(*) as n_docs from documents where doc_id % 3 = 0 having count(*) > 0 union all select n, c from (select unnest(['Minas Gerais', 'Norte', 'Rio Grande do Norte']) as n, count(*) as c from documents where doc_id % 5 = 0 group by 1)")
def d9(s, d):
    # the tables name no places: they are added to the texts
    n = F.col("doc_id")
    more = F.concat_ws(" ", F.col("text"), F.when(n % 3 == 0, " BRASIL,"), F.when(n % 5 == 0, " minas  gerais e Rio Grande do\nNorte; consulado nortenho"))
    return analytics.place_mentions(docs(s, d).select("doc_id", more.alias("text")))


query("d13_alert_new_results", "select event_id from events where event_type = 'error' and event_id % 4 <> 0")(lambda s, d: analytics.fresh(table(s, d, "events").where("event_type = 'error'").select("event_id"), table(s, d, "events").where("event_type = 'error' and event_id % 4 = 0").select("event_id"), ["event_id"]))
query("d17_content_duplicates", CAT + " select a.name as submitted, b.name as existing from cat a join cat b on a.content_hash = b.content_hash and a.name <> b.name where a.ingest_seq % 2 = 1 and b.ingest_seq % 2 = 0")(lambda s, d: cat(s, d).where("ingest_seq % 2 = 1").select("content_hash", F.col("name").alias("submitted")).join(cat(s, d).where("ingest_seq % 2 = 0").select("content_hash", F.col("name").alias("existing")), "content_hash").where("submitted <> existing").select("submitted", "existing"))
query("d18_rag_context", PAGE + ", h as (" + FTS.format(w="list_contains(t, 'the')") + ") select file_id, first, length(substr(text, 1, 6000)) as n from (select file_id, min(rank) as first from h group by 1 order by 2 limit 5) join (select substr(sha256(cast(doc_id as varchar)), 1, 16) as file_id, text from documents) using (file_id)")(lambda s, d: _rag(s, d, 5, 6000))
query("d19_rag_context", PAGE + ", h as (" + FTS.format(w="list_contains(t, 'the')") + ") select file_id, first, length(substr(text, 1, 500)) as n from (select file_id, min(rank) as first from h group by 1 order by 2 limit 3) join (select substr(sha256(cast(doc_id as varchar)), 1, 16) as file_id, text from documents) using (file_id)")(lambda s, d: _rag(s, d, 3, 500))


def _rag(s, d, max_docs, chars):
    texts = docs(s, d).select(readers.file_id(F.col("doc_id")).alias("file_id"), "text")
    return fulltext.rag_context(search(s, d, "the"), texts, max_docs, chars).select("file_id", "first", F.length("context").cast("long").alias("n"))


# Aggregates

query("e1_dashboard", CAT + " select count(*) as n_docs, cast(sum(num_pages) as bigint) as total_pages, cast(sum(file_size) as bigint) as total_size, cast(sum(word_count) as bigint) as total_words, cast(sum(file_size) // count(*) as bigint) as avg_size, sum(ocr_percentage * num_pages) / sum(case when ocr_percentage is not null then num_pages end) as weighted_ocr, avg(ocr_avg_confidence) as avg_confidence, count(*) filter (where ocr_avg_confidence < 70) as low_ocr, count(*) filter (where word_count = 0) as empty_text, max(substr(indexed_at, 1, 10)) as latest from cat")(lambda s, d: analytics.dashboard(cat(s, d)))
query("e1_upper_median", CAT + " select language, list_sort(list(file_size))[count(*) // 2 + 1] as median_size from cat group by 1")(lambda s, d: analytics.quantiles(cat(s, d), "file_size", [0.5], ["language"]).select("language", F.col("file_size").alias("median_size")))
query("e1_by_type", CAT + " select coalesce(doc_type, 'documento') as doc_type, count(*) as n, cast(sum(num_pages) as bigint) as pages from cat group by 1")(lambda s, d: analytics.by_type(cat(s, d)))
query("e1_per_day", CAT + " select substr(indexed_at, 1, 10) as day, count(*) as n from cat group by 1 order by 1 desc limit 90")(lambda s, d: analytics.per_day(cat(s, d)))
query("e1_size_histogram", CAT + " select cast((file_size >= 500)::int + (file_size >= 1000)::int + (file_size >= 5000)::int + (file_size >= 10000)::int as integer) as bucket, count(*) as n from cat group by 1")(lambda s, d: analytics.size_histogram(cat(s, d), [500, 1000, 5000, 10000]))
query("e2_exact_duplicate_groups", CAT + " select content_hash, count(*) over (partition by content_hash) as n, ingest_seq, id from cat qualify count(*) over (partition by content_hash) >= 2")(lambda s, d: similar.exact_groups(cat(s, d)))
WORDS = "w as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) > 2 and not list_contains([" + _STOPS + "], x) and not regexp_matches(x, '^[0-9]+$')) as t from documents)"
query("e4_top_words", "with " + WORDS + " select word, count(*) as n from (select unnest(t) as word from w) group by 1 having count(*) >= 2 order by n desc, word limit 50")(lambda s, d: analytics.top_words(docs(s, d), STOP))
query("e5_top_bigrams", "with " + WORDS + " select bigram, count(*) as n from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as bigram from w) group by 1 order by n desc, bigram limit 30")(lambda s, d: analytics.top_bigrams(docs(s, d), STOP))
query("e6_cloud_words", "with " + WORDS + ", a as (select word, count(*) as n from (select unnest(t) as word from w) group by 1 order by n desc, word limit 75), b as (select bigram, count(*) as n from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as bigram from w) group by 1 order by n desc, bigram limit 20) select word, n from a union all select bigram, n from b")(lambda s, d: analytics.top_words(docs(s, d), STOP, 75).union(analytics.top_bigrams(docs(s, d), STOP, 20)))
query("e7_distinct_terms", "select count(distinct w) as terms, count(*) as tokens from (select unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) as w from documents)")(lambda s, d: docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w")).agg(F.count_distinct("w").alias("terms"), F.count("*").alias("tokens")))
query("e9_totals", CAT + " select count(*) as n, cast(sum(num_pages) as bigint) as pages, round(sum(file_size) / 1048576.0, 2) as mb, max(indexed_at) as latest from cat")(lambda s, d: cat(s, d).agg(F.count("*").alias("n"), F.sum("num_pages").cast("long").alias("pages"), F.round(F.sum("file_size") / 1048576.0, 2).alias("mb"), F.max("indexed_at").alias("latest")))
query("e11_by_language_year", CAT + " select language, substr(indexed_at, 1, 4) as year, count(*) as n from cat group by grouping sets ((language), (substr(indexed_at, 1, 4)))")(lambda s, d: cat(s, d).withColumn("year", F.substring("indexed_at", 1, 4)).groupingSets([["language"], ["year"]], "language", "year").agg(F.count("*").alias("n")))
query("e17_contract_summary", "with c as (select cast(cast(o_orderdate as date) as varchar) as e from orders) select count(*) as total, count(*) filter (where e < '1998-01-01') as expired, count(*) filter (where cast(e as date) - date '1998-01-01' between 0 and 30) as within_30, count(*) filter (where cast(e as date) - date '1998-01-01' between 31 and 90) as within_90, count(*) filter (where e is null) as no_date from c")(lambda s, d: analytics.contract_summary(table(s, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("end_date")), "1998-01-01"))
query("e19_quantiles", "with v as (select list_sort(list(value)) as v from events where value is not null), q as (select unnest([0.5, 0.95, 0.99]) as q) select cast(q as double) as q, v[cast(floor(len(v) * q) as bigint) + 1] as value from v, q")(lambda s, d: analytics.quantiles(table(s, d, "events"), "value", [0.5, 0.95, 0.99]))
query("e28_counter", "select event_type, user_id % 10 as status, count(*) as n from events group by 1, 2")(lambda s, d: table(s, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("status")).agg(F.count("*").alias("n")))
query("e25_integrity", CAT + " select status, count(*) as n from (select case when ingest_seq % 11 = 0 then 'missing_text' when ingest_seq % 13 = 0 then 'missing_source' when ingest_seq % 17 = 0 then 'changed' else 'ok' end as status from cat) group by 1")(lambda s, d: catalog.integrity(cat(s, d), cat(s, d).where("ingest_seq % 11 <> 0").select("id", F.lit(True).alias("has_text")), cat(s, d).where("ingest_seq % 13 <> 0").select("id", F.when(F.col("ingest_seq") % 17 == 0, "x").otherwise(F.col("content_hash")).alias("current_hash"))).groupBy("status").agg(F.count("*").alias("n")))

# Ranking

TL = "tl as (select id, ingest_seq, case when ingest_seq % 5 = 0 then '2019-0' || (ingest_seq % 9 + 1) || '-15' when ingest_seq % 5 = 1 then '2021-12-0' || (ingest_seq % 9 + 1) else substr(indexed_at, 1, 10) end as date_iso, case when ingest_seq % 5 = 0 then 'metadata' when ingest_seq % 5 = 1 then 'content' else 'indexed' end as source, cast(case when ingest_seq % 5 = 0 then 1.0 when ingest_seq % 5 = 1 then 0.8 else 0.5 end as double) as confidence from cat)"


def _timeline(s, d):
    n = F.col("ingest_seq")
    month = (n % 9 + 1).cast("string")
    return analytics.timeline(cat(s, d).select("id", n, F.when(n % 5 == 0, F.concat(F.lit("2019-0"), month, F.lit("-15"))).alias("pdf_date"), F.when(n % 5 == 1, F.array(F.lit("bad"), F.concat(F.lit("2021-12-0"), month))).alias("content_dates"), "indexed_at"))


query("f7_timeline", CAT + ", " + TL + " select * from tl")(_timeline)
query("e13_docs_per_year", CAT + ", " + TL + " select cast(substr(date_iso, 1, 4) as integer) as year, cast(substr(date_iso, 6, 2) as integer) as month, count(*) as n from tl group by 1, 2")(lambda s, d: _timeline(s, d).groupBy(F.substring("date_iso", 1, 4).cast("int").alias("year"), F.substring("date_iso", 6, 2).cast("int").alias("month")).agg(F.count("*").alias("n")))
query("e15_timeline_stats", CAT + ", " + TL + " select count(*) as total, count(*) filter (where confidence >= 0.8) as precise, cast(max(substr(date_iso, 1, 4)::int) - min(substr(date_iso, 1, 4)::int) as integer) as span_years, min(date_iso) as oldest, max(date_iso) as newest from tl")(lambda s, d: analytics.timeline_stats(_timeline(s, d)))
query("f9_expiring", "select cast(o_orderkey as varchar) as id, cast(cast(o_orderdate as date) as varchar) as end_date, cast(cast(o_orderdate as date) - date '1998-01-01' as integer) as days_left, case when cast(o_orderdate as date) - date '1998-01-01' < 0 then 'expired' when cast(o_orderdate as date) - date '1998-01-01' <= 7 then 'critical' else 'warning' end as severity from orders where cast(o_orderdate as date) - date '1998-01-01' <= 30")(lambda s, d: analytics.expiring(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("end_date")), "1998-01-01"))
query("f13_last_corrections", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 order by event_id desc limit 50")(lambda s, d: catalog.newest_per_key(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 50))
query("f15_highlights")(lambda s, d: docs(s, d).select("doc_id", text.highlight(F.col("text"), "thing").alias("snippet")).where("snippet is not null"))
query("f16_sampled_pages", CAT + " select id, array_to_string(list_distinct(list_transform(range(0, 5), lambda i: (i * num_pages) // 5)).list_sort(), ',') as idx from cat")(lambda s, d: cat(s, d).select("id", F.array_join(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * F.col("num_pages") / 5)))), ",").alias("idx")))
query("k3_rate_limit", "select event_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as recent from events")(lambda s, d: analytics.rate(table(s, d, "events"), "user_id", "ts").select("event_id", "recent"))
query("k13_rolling_samples", "select event_id, avg(value) over (order by event_id rows between 999 preceding and current row) as mean from events where user_id = 7")(lambda s, d: table(s, d, "events").where("user_id = 7").selectExpr("event_id", "avg(value) over (order by event_id rows between 999 preceding and current row) as mean"))
query("x_event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")(lambda s, d: table(s, d, "events").groupBy(F.window(F.col("ts"), "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))

# Scalar functions

query("i2_normalize", "select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as t from documents")(lambda s, d: docs(s, d).select("doc_id", text.normalize(F.col("text")).alias("t")))
query("i3_shingle_counts", "with n as (select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as t from documents), ch as (select doc_id, length(t) as n, unnest(string_split(t, '')) as c, generate_subscripts(string_split(t, ''), 1) as i from n), g as (select doc_id, n, c || lead(c, 1) over w || lead(c, 2) over w || lead(c, 3) over w || lead(c, 4) over w as s from ch window w as (partition by doc_id order by i)) select doc_id, cast(greatest(count(distinct s), least(max(n), 1)) as integer) as n from g group by doc_id")(lambda s, d: docs(s, d).select("doc_id", F.size(text.char_shingles(F.col("text"))).alias("n")))
query("i45_word_counts", "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as bigint) as words, length(text) as chars from documents")(lambda s, d: docs(s, d).select("doc_id", text.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars")))
query("i32_language", "with w as (select doc_id, list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+')) as t from documents), n as (select doc_id, len(list_intersect(t, [" + ", ".join(f"'{w}'" for w in classify.COMMON_PT) + "])) as pt, len(list_intersect(t, [" + ", ".join(f"'{w}'" for w in classify.COMMON_EN) + "])) as en from w) select doc_id, case when pt > en then 'pt-BR' when en > pt then 'en' else 'unknown' end as language from n")(lambda s, d: docs(s, d).select("doc_id", classify.language(F.col("text")).alias("language")))


def queries() -> dict[str, Query]:
    from foliant.plans import content, extra, records, rules  # noqa: F401 - add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from foliant.plans import content, extra, records, rules  # noqa: F401

    return dict(SQL)
