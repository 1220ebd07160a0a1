"""Queries over PDF scans, formulas, structure and further entities, by inventory number, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import classify, dates, entities, forensics, formulas, signatures, structure, text
from foliant.operators import catalog, fulltext, ingest, records
from foliant.plans.archive import CAT, PAGE, _id, cat, docs, pages, query, vecs
from foliant.plans.records import signed
from foliant.sources import pdf, pdf_writer
from foliant.sources.readers import content_hash, table
from foliant.storage import stored

PARTS = "string_split(coalesce(text, ''), chr(10))"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A PDF of every document, a page for each of its lines: path, content."""
    d = docs(spark, sf).withColumn("text", F.coalesce("text", F.lit(""))).repartition(2 * spark.sparkContext.defaultParallelism)  # a small table is one split
    return d.select(F.col("doc_id").cast("string").alias("path"), pdf_writer.pdf(F.split("text", "\n"), F.concat(F.lit("doc-"), F.col("doc_id"))).alias("content"))


query("a2_pdf_status", f"select cast(doc_id as varchar) as path, 'ok' as status, len({PARTS}) as num_pages, 'doc-' || doc_id as title from documents")(lambda s, d: pdf.read_pdf(files(s, d)).select("path", "status", F.col("num_pages").cast("long").alias("num_pages"), F.col("info")["Title"].alias("title")))
query("a3_pdf_text", f"select cast(doc_id as varchar) as path, array_to_string(list_filter({PARTS}, lambda x: x <> ''), chr(10) || chr(10)) as text from documents")(lambda s, d: pdf.read_pdf(files(s, d)).select("path", pdf.full_text(F.col("pages")).alias("text")))
query("a28_pdf_page_sizes", f"select cast(doc_id as varchar) as path, unnest(range(1, len({PARTS}) + 1)) as n, 595.0::double as width, 842.0::double as height, 0 as rotation from documents")(lambda s, d: pdf.pdf_pages(pdf.read_pdf(files(s, d))).select("path", F.col("n").cast("long").alias("n"), "width", "height", "rotation"))
query("g7_pdf_fonts", "select cast(doc_id as varchar) as path, 'Helvetica' as name, 'Type1' as kind from documents")(lambda s, d: pdf.read_pdf(files(s, d)).select("path", F.explode(F.slice(F.array_distinct(F.flatten(F.transform("pages", lambda p: p["fonts"]))), 1, 50)).alias("f")).select("path", "f.*"))


@query("b25_dossier")
def b25(s, d):
    hits = docs(s, d).where("lang = 'en'").select(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("file_id"), F.col("source").alias("name"), F.col("doc_id").alias("rank"))
    made = pdf_writer.dossier(hits, pages(s, d).select("file_id", "page", "text"), "Results")
    return pdf.read_pdf(made.select(F.lit("dossier").alias("path"), "content")).select("status", "num_pages", F.col("pages")[0]["text"].alias("cover"))


# Formulas

query("i37_i38_formulas")(lambda s, d: formulas.page_hits(pages(s, d)))

# Entities, texts, signatures

query("i17_urls", "select doc_id, len(regexp_extract_all(text, '(?i)https?://[^\\s<>\"'']+')) as n from documents")(lambda s, d: docs(s, d).select("doc_id", F.size(entities.mask(F.col("text"), "url")).cast("long").alias("n")))
query("d4_signature_scan")(lambda s, d: signatures.all_pairs(signed(s, d), 0.75)[0])
query("i8_cosine", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")(lambda s, d: vecs(s, d).alias("a").join(vecs(s, d).withColumnRenamed("embedding", "e").withColumn("k", F.col("id") - 1).alias("b"), F.col("a.id") == F.col("b.k")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(_cosine("embedding", "e"), 4).alias("c")))


def _cosine(a: str, b: str):
    from foliant.functions.vectors import dot, unit

    return dot(unit(F.col(a)), unit(F.col(b)))


# Masks and synonyms

query("c8_masks")(lambda s, d: fulltext.mask_hits(docs(s, d).select(F.col("doc_id").alias("id"), "text")))
# Extractors over all documents: a row for each document, or for each hit where one row is one hit


def over_documents(spark: SparkSession, sf: str, **made) -> DataFrame:
    return docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in made.items()])


def hits(spark: SparkSession, sf: str, values) -> DataFrame:
    """doc_id, value: what an array of texts has, distinct by document."""
    return docs(spark, sf).select("doc_id", F.explode(F.array_distinct(values)).alias("value"))


body = lambda: F.col("text")  # noqa: E731 - a column needs a session
query("i16_i22_entities")(lambda s, d: over_documents(s, d, **entities.entities(body())))
query("i21_domain_check")(lambda s, d: hits(s, d, entities.mask(body(), "domain")).withColumn("ok", entities.valid_domain(F.col("value"))))
query("j1_dates")(lambda s, d: over_documents(s, d, dates=dates.extract_dates(body())))
query("j2_parse_date")(lambda s, d: over_documents(s, d, parsed=dates.parse_date(body())))
query("j6_j7_j8_j9_any_date")(lambda s, d: over_documents(s, d, parsed=dates.any_date(body())))
query("j3_contract_terms")(lambda s, d: over_documents(s, d, **dates.contract_terms(body())))
query("i36_latex")(lambda s, d: over_documents(s, d, latex=formulas.latex(body())))
query("e21_formula_counts")(lambda s, d: formulas.counts(formulas.page_hits(pages(s, d))))
query("i39_formula_sections")(lambda s, d: formulas.markdown(formulas.page_hits(pages(s, d))))
query("c9_c10_term_and_mask")(lambda s, d: fulltext.mask_hits(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "the"))

# Catalog, timeline and log variants

query("b30_delete_by_id_or_name", CAT + " select id, name from cat where ingest_seq <> 7 and name <> 'doc-9.pdf'")(lambda s, d: catalog.removed(catalog.removed(cat(s, d), s.createDataFrame([(_id(7),)], "id string")), s.createDataFrame([("doc-9.pdf",)], "id string"), "name").select("id", "name"))
query("b31_delete_postings", PAGE + " select unnest(t) as token, file_id, page from tok where ingest_seq <> 7")(lambda s, d: catalog.removed(fulltext.postings(pages(s, d)), s.createDataFrame([(_id(7),)], "id string"), "file_id").select("token", "file_id", F.col("page").cast("long").alias("page")))
query("c2_lookup", CAT + " select name from cat where ingest_seq = 7")(lambda s, d: catalog.find(cat(s, d), _id(7)).select("name"))
query("c19_projection", CAT + " select id, coalesce(doc_type, 'documento') as doc_type, coalesce(language, '') as language, substr(indexed_at, 1, 10) as day from cat")(lambda s, d: cat(s, d).select("id", F.coalesce("doc_type", F.lit("documento")).alias("doc_type"), F.coalesce("language", F.lit("")).alias("language"), F.substring("indexed_at", 1, 10).alias("day")))
query("e10_counts", CAT + " select count(*) as files, sum(num_pages)::bigint as pages from cat")(lambda s, d: cat(s, d).agg(F.count("*").alias("files"), F.sum("num_pages").alias("pages")))
query("e14_year_month", CAT + " select cast(substr(indexed_at, 1, 4) as integer) as year, cast(substr(indexed_at, 6, 2) as integer) as month, count(*) as n from cat group by 1, 2")(lambda s, d: cat(s, d).groupBy(F.substring("indexed_at", 1, 4).cast("int").alias("year"), F.substring("indexed_at", 6, 2).cast("int").alias("month")).agg(F.count("*").alias("n")))
query("e16_date_range", CAT + " select min(indexed_at) as first, max(indexed_at) as last from cat")(lambda s, d: cat(s, d).agg(F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last")))
query("e29_e30_counters", "select event_type, count(*) filter (value > 50) as hits, count(*) filter (not coalesce(value > 50, false)) as misses from events group by 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count_if(~F.coalesce(F.col("value") > 50, F.lit(False))).alias("misses")))
query("f12_expired", "select event_id from events where ts >= (select max(ts) from events) - interval 24 hours")(lambda s, d: table(s, d, "events").crossJoin(F.broadcast(table(s, d, "events").agg(F.max("ts").alias("now")))).where("ts >= now - interval 24 hours").select("event_id"))
query("g2_outer_union", "select coalesce(a.doc_id, b.doc_id) as id, a.doc_id is not null as fts, b.doc_id is not null as semantic from (select doc_id from documents where lang = 'en') a full join (select doc_id from labels where quality = 1) b on a.doc_id = b.doc_id")(lambda s, d: docs(s, d).where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit(True).alias("fts")).join(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("semantic")), "id", "full_outer").select("id", F.coalesce("fts", F.lit(False)).alias("fts"), F.coalesce("semantic", F.lit(False)).alias("semantic")))
query("g3_orphan_postings", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")(lambda s, d: docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti"))


# Configuration of full text, chunks of other lists

query("f5_weighted_rrf", "with a as (select doc_id, row_number() over (order by doc_id) as r from (select doc_id from documents order by doc_id limit 20)), b as (select doc_id, row_number() over (order by doc_id desc) as r from (select doc_id from documents order by doc_id limit 30)), u as (select doc_id, 10.0 / (60 + r) as s from a union all select doc_id, 1.0 / (60 + r) from b) select doc_id, round(sum(s), 6)::double as score from u group by 1")(lambda s, d: _fused(s, d))
query("g8_parties", "select distinct trim(source) as party from documents where trim(source) <> ''")(lambda s, d: docs(s, d).select(F.trim("source").alias("party")).where("party <> ''").distinct())
query("i33_cloud_text", "select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as t from documents")(lambda s, d: docs(s, d).select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " ")).alias("t")))


def _fused(s, d):
    ranked = lambda n, order: docs(s, d).select("doc_id").orderBy("doc_id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(order)))  # noqa: E731 - n rows
    return fulltext.fuse([(ranked(20, F.asc("doc_id")), 10.0), (ranked(30, F.desc("doc_id")), 1.0)], ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


# Ingest

# copies have one record, that of the least path; contents of paths that end in 7 are known before
FIRSTS = "(select min(cast(doc_id as varchar)) as path, coalesce(text, '') as text, bool_or(cast(doc_id as varchar) like '%7') as known from documents group by coalesce(text, ''))"
query("k4_ingest", f"select path as name, len({PARTS}) as num_pages, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as word_count from {FIRSTS} where not known")(lambda s, d: _ingested(s, d).select("name", F.col("num_pages").cast("long").alias("num_pages"), "word_count"))
query("b28_b29_sealed", "select doc_id, text, text is not null as changed from documents")(lambda s, d: docs(s, d).select("doc_id", F.col("text").cast("binary").alias("p")).withColumn("e", ingest.sealed(F.col("p"), _key())).select("doc_id", ingest.opened(F.col("e"), _key()).cast("string").alias("text"), (F.coalesce(F.col("e"), F.lit("").cast("binary")) != F.coalesce(F.col("p"), F.lit("").cast("binary"))).alias("changed")))
query("a6_pages_for_ocr", PAGE + r" select file_id, cast(page as bigint) as page from page where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50")(lambda s, d: pages(s, d).where(ingest.needs_ocr(F.col("text")) & (F.length(text.strip(F.col("text"))) < 50)).select("file_id", F.col("page").cast("long").alias("page")))


def _key():
    return F.lit("0123456789abcdef").cast("binary")


def _ingested(s, d):
    # files of equal pages differ in their titles: here they have none
    made = docs(s, d).select(F.col("doc_id").cast("string").alias("path"), pdf_writer.pdf(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit("")).alias("content"))
    made, _ = stored(made.repartition(2 * s.sparkContext.defaultParallelism), "files")  # as files on a disk
    known = made.where("path like '%7'").select(content_hash(F.col("content")).alias("content_hash"))
    return ingest.ingest(made, known)
