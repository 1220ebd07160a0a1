"""Record tables beside the catalog: annotations, soft deletions, saved searches and grants. Each takes and returns whole tables."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip

#: Kinds of annotation, the colour of one without a valid colour, and what a colour looks like.
KINDS = ["highlight", "note"]
YELLOW = "#FFFF00"
COLOUR = "^#[0-9A-Fa-f]{6}$"

STRINGS = "array<string>"


def annotation_error() -> Column:
    """Why an annotation can't be stored: type, page, text or position; null if it can."""
    outside = lambda c: c.isNull() | ~c.between(0, 1)
    misplaced = F.col("position").isNotNull() & (outside(F.col("position.x")) | outside(F.col("position.y")))
    checks = [
        ("type", F.col("type").isNull() | ~F.col("type").isin(KINDS)),
        ("page", F.col("page").isNull() | (F.col("page") < 1)),
        ("text", F.coalesce(strip(F.col("text")), F.lit("")) == ""),
        ("position", misplaced),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])


def colour() -> Column:
    return F.when(F.col("color").rlike(COLOUR), F.col("color")).otherwise(F.lit(YELLOW))


def add_annotations(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """old with the valid rows of new, times set to now; their text is stripped, an invalid colour becomes yellow."""
    good = new.where(annotation_error().isNull())
    done = good.withColumns({"text": strip(F.col("text")), "color": colour(), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return old.unionByName(done)


def rejected_annotations(new: DataFrame) -> DataFrame:
    return new.withColumn("error", annotation_error()).where("error is not null")


def update_annotations(old: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The fields of changes (file_id, id and any others), where not null, replace those of the same annotation.

    id, file_id and created_at stay; a change that would make the annotation invalid leaves it as it was. One change an id."""
    fields = [c for c in changes.columns if c in old.columns and c not in ("id", "file_id", "created_at", "updated_at")]
    one = changes.select("file_id", "id", F.struct(*fields).alias("_change")).dropDuplicates(["file_id", "id"])
    joined = old.join(one, ["file_id", "id"], "left").withColumn("_old", F.struct(*old.columns))
    new = joined.withColumns({c: F.coalesce(F.col("_change")[c], F.col(c)) for c in fields})
    valid = F.col("_change").isNotNull() & annotation_error().isNull() & F.coalesce(F.col("color").rlike(COLOUR), F.lit(True))
    new = new.withColumn("_valid", valid)
    kept = {c: F.when(F.col("_valid"), F.col(c)).otherwise(F.col("_old")[c]).alias(c) for c in old.columns}
    kept["updated_at"] = F.when(F.col("_valid"), F.lit(now)).otherwise(F.col("_old.updated_at")).alias("updated_at")
    return new.select(*kept.values())


def delete_annotations(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select("file_id", "id"), ["file_id", "id"], "left_anti")


def annotation_counts(notes: DataFrame) -> DataFrame:
    """file_id, n of the files with an annotation."""
    return notes.groupBy("file_id").agg(F.count("*").alias("n"))


def annotation_export(notes: DataFrame) -> DataFrame:
    """file_id, total, annotations (array of struct by page and id). A file's notes are made by hand: the array stays small."""
    fields = ["page", "id", *[c for c in notes.columns if c not in ("page", "id", "file_id")]]
    return notes.groupBy("file_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct(*fields))).alias("annotations"))


def tombstones(meta: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """file_id, metadata (JSON of the whole record), deleted_iso of the records to delete softly."""
    gone = meta.join(ids.select("id").distinct(), "id", "left_semi")
    return gone.select(F.col("id").alias("file_id"), F.to_json(F.struct(*meta.columns)).alias("metadata"), F.lit(now).alias("deleted_iso"))


def alive(meta: DataFrame, dead: DataFrame) -> DataFrame:
    return meta.join(dead.select(F.col("file_id").alias("id")), "id", "left_anti")


def restored(meta: DataFrame, dead: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """meta with the records of ids from their tombstones, and the tombstones that remain."""
    chosen = ids.select(F.col("id").alias("file_id")).distinct()
    back = dead.join(chosen, "file_id", "left_semi").select(F.from_json("metadata", meta.schema).alias("r")).select("r.*")
    return meta.unionByName(back), dead.join(chosen, "file_id", "left_anti")


def save_searches(saved: DataFrame, new: DataFrame, now: float, overwrite: bool = True) -> DataFrame:
    """saved with new (name, query, options) by name: created_at stays, what a run has seen is forgotten.

    Without overwrite a name that is taken keeps its search. One new row a name."""
    fresh = new.select("name", "query", F.coalesce("options", F.create_map().cast("map<string,string>")).alias("options")).dropDuplicates(["name"])
    if not overwrite:
        fresh = fresh.join(saved, "name", "left_anti")
    first = saved.select("name", F.col("created_at").alias("_first"))
    rows = fresh.join(first, "name", "left").select("name", "query", "options", F.coalesce("_first", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("double").alias("last_run_at"), F.array().cast(STRINGS).alias("last_seen_ids"))
    return saved.join(fresh, "name", "left_anti").select(*rows.columns).unionByName(rows)


def cleared(rows: DataFrame) -> DataFrame:
    """The table without its rows."""
    return rows.where(F.lit(False))


def without_searches(saved: DataFrame, names: DataFrame) -> DataFrame:
    return saved.join(names.select("name"), "name", "left_anti")


def changed_grants(acl: DataFrame, changes: DataFrame) -> DataFrame:
    """user, allowed, deny after changes (seq, user, file_id, granted): the last change of a user's file decides.

    A grant adds to allowed and removes from deny, a revocation does the opposite. Ids are kept in ascending order."""
    last = changes.groupBy("user", "file_id").agg(F.max_by("granted", "seq").alias("granted"))
    ids = lambda granted: F.collect_list(F.when(F.col("granted") == granted, F.col("file_id")))
    per_user = last.groupBy("user").agg(ids(True).alias("given"), ids(False).alias("taken"))
    none = lambda c: F.coalesce(c, F.array().cast(STRINGS))
    side = lambda old, more, less: F.array_sort(F.array_union(F.array_except(none(F.col(old)), none(F.col(less))), none(F.col(more))))
    return acl.join(per_user, "user", "full_outer").select("user", side("allowed", "given", "taken").alias("allowed"), side("deny", "taken", "given").alias("deny"))


def line_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """page, additions, deletions, identical for the pages (page, text) of either document, by their lines as multisets.

    A line that only moves counts as neither; identical compares the texts."""
    lines = lambda df, sign: df.select("page", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"), F.lit(sign).alias("sign"))
    net = lines(a, -1).unionByName(lines(b, 1)).where("line <> ''").groupBy("page", "line").agg(F.sum("sign").alias("net"))
    counts = net.groupBy("page").agg(F.sum(F.greatest("net", F.lit(0))).alias("additions"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("deletions"))
    both = a.select("page", F.col("text").alias("_a")).join(b.select("page", F.col("text").alias("_b")), "page", "full_outer").join(counts, "page", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("page", zero("additions"), zero("deletions"), F.coalesce("_a", F.lit("")).eqNullSafe(F.coalesce("_b", F.lit(""))).alias("identical"))


def newest_searches(saved: DataFrame) -> DataFrame:
    """saved with rank, the last updated first."""
    # one row a search that somebody named: a small table
    return saved.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("updated_at"), "name")))


def unified_diff(pairs: DataFrame, context: int = 2) -> DataFrame:
    """pairs (a, b: texts; null counts as empty) with unified (lines), additions, deletions, identical, pair by pair in Arrow batches."""

    def changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            old, new = (x or "").splitlines(), (y or "").splitlines()
            lines = list(difflib.unified_diff(old, new, "a", "b", n=context, lineterm=""))
            begin = lambda mark: sum(v.startswith(mark) and not v.startswith(mark * 3) for v in lines)
            rows.append((lines, begin("+"), begin("-"), old == new))
        return pd.DataFrame(rows, columns=["unified", "additions", "deletions", "identical"])

    made = F.pandas_udf(changes, "unified array<string>, additions int, deletions int, identical boolean")
    return pairs.withColumn("_d", made("a", "b")).select(*pairs.columns, "_d.*")
