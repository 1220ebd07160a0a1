"""Queries over record tables and signatures, by inventory number, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import signatures
from foliant.operators import records
from foliant.plans.archive import CAT, cat, docs, query

NOW, LATER = "2025-06-01T00:00:00Z", "2025-06-02T00:00:00Z"

NEW = """with raw as (
  select 'n' || doc_id as id, source as file_id, (['note', 'highlight', 'stamp'])[doc_id % 3 + 1] as type, cast(doc_id % 5 as integer) as page,
    '  note ' || doc_id || ' ' as text, case when doc_id % 2 = 0 then '#12ab9F' else 'red' end as color, doc_id % 7 / 6.0 as x from documents),
good as (
  select id, file_id, type, page, trim(text) as text, case when color = 'red' then '#FFFF00' else color end as color, '2025-06-01T00:00:00Z' as created_at, '2025-06-01T00:00:00Z' as updated_at
  from raw where type <> 'stamp' and page >= 1 and file_id is not null and x <= 0.9)"""


def new_notes(spark: SparkSession, sf: str) -> DataFrame:
    d, n = docs(spark, sf).where("source is not null"), F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["note", "highlight", "stamp"])), (n % 3 + 1).cast("int"))
    # x beyond 1 where doc_id % 7 is 6
    place = F.struct(F.when(n % 7 == 6, F.lit(1.5)).otherwise(F.lit(0.5)).alias("x"), F.lit(0.5).alias("y"))
    return d.select(F.concat(F.lit("n"), n).alias("id"), F.col("source").alias("file_id"), kind.alias("type"), (n % 5).cast("int").alias("page"), F.concat(F.lit("  note "), n, F.lit(" ")).alias("text"), F.when(n % 2 == 0, "#12ab9F").otherwise("red").alias("color"), place.alias("position"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    new = new_notes(spark, sf)
    empty = new.where("false").withColumns({"created_at": F.lit(NOW), "updated_at": F.lit(NOW)})
    return records.add_annotations(empty, new, NOW)


query("i50_add_annotations", NEW + " select * from good")(lambda s, d: notes(s, d).drop("position"))
query("i50_rejected_annotations", NEW + " select id, case when type = 'stamp' then 'type' when page < 1 then 'page' else 'position' end as error from raw where file_id is not null and (type = 'stamp' or page < 1 or x > 0.9)")(lambda s, d: records.rejected_annotations(new_notes(s, d)).select("id", "error"))


@query("i51_update_annotations", NEW + f" select id, case when cast(substr(id, 2) as bigint) % 4 = 0 then 'seen' else text end as text, created_at, case when cast(substr(id, 2) as bigint) % 4 = 0 then '{LATER}' else updated_at end as updated_at from good")
def i51(s, d):
    old = notes(s, d)
    number = F.substring("id", 2, 20).cast("long")
    # a page of 0 makes a change invalid
    changes = old.where(number % 4 < 2).select("file_id", "id", F.lit("seen").alias("text"), F.when(number % 4 == 1, 0).alias("page"))
    return records.update_annotations(old, changes, LATER).select("id", "text", "created_at", "updated_at")


query("i52_delete_annotations", NEW + " select id from good where page <> 2")(lambda s, d: records.delete_annotations(notes(s, d), notes(s, d).where("page = 2")).select("id"))
query("i53_annotation_counts", NEW + " select file_id, count(*) as n from good group by 1")(lambda s, d: records.annotation_counts(notes(s, d)))
query("i54_annotated_files", NEW + " select distinct file_id from good")(lambda s, d: notes(s, d).select("file_id").distinct())
query("i55_annotations_of_a_file", NEW + " select id, page from good where file_id = (select min(file_id) from good)")(lambda s, d: notes(s, d).join(notes(s, d).agg(F.min("file_id").alias("file_id")), "file_id", "left_semi").select("id", "page"))
query("i56_annotation_export", NEW + " select file_id, count(*) as total, string_agg(id, ',' order by page, id) as ids from good group by 1")(lambda s, d: records.annotation_export(notes(s, d)).select("file_id", "total", F.array_join("annotations.id", ",").alias("ids")))

query("k7_soft_delete", CAT + " select id, name from cat where ingest_seq % 10 <> 0")(lambda s, d: records.alive(cat(s, d), records.tombstones(cat(s, d), cat(s, d).where("ingest_seq % 10 = 0"), NOW)).select("id", "name"))
query("k9_tombstones", CAT + f" select id as file_id, name, '{NOW}' as deleted_iso from cat where ingest_seq % 10 = 0")(lambda s, d: records.tombstones(cat(s, d), cat(s, d).where("ingest_seq % 10 = 0"), NOW).select("file_id", F.get_json_object("metadata", "$.name").alias("name"), "deleted_iso"))


@query("k8_undelete", CAT + " select id, name, word_count from cat where ingest_seq % 10 <> 0 or ingest_seq % 20 = 0")
def k8(s, d):
    meta = cat(s, d)
    dead = records.tombstones(meta, meta.where("ingest_seq % 10 = 0"), NOW)
    return records.restored(records.alive(meta, dead), dead, meta.where("ingest_seq % 20 = 0"))[0].select("id", "name", "word_count")


def signed(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(F.col("doc_id").alias("id"), signatures.signature(F.col("text")).alias("signature"))


query("i4_signatures")(signed)
query("i7_unsigned", r"select doc_id as id from documents where text is null or length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20")(lambda s, d: signed(s, d).where("signature is null").select("id"))
query("d5_signature_pairs")(lambda s, d: signatures.near_pairs(signed(s, d), 0.75)[0])
query("d20_signature_classes")(lambda s, d: signatures.near_pairs(signed(s, d), 0.75)[1])
