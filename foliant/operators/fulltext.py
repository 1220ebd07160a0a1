"""Boolean full-text search over postings: terms, phrases, AND, OR, NOT.

Postings are stored once, by bucket of the token and sorted by it. A query is parsed on the driver; it reads the buckets of
its own tokens, gathers them by page in one aggregation, and looks at no text."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.entities import ALIASES, MASKS
from foliant.functions.text import ACCENTED, PLAIN, tokens
from foliant.storage import Store

KEY = ["file_id", "page"]
OPERATORS = {"AND", "OR", "NOT", "NEAR"}
_SPECIAL = re.compile(r"[^\w\s]")


#: Buckets of an index, by a hash of the token.
BUCKETS = 64
#: Tasks that a bucket is dealt to when an index is written: a token that every page has isn't one task's.
PIECES = 4


def postings(pages: DataFrame) -> DataFrame:
    """token, file_id, page, pos and, if pages has it, ingest_seq of pages (file_id, page, text)."""
    more = [c for c in ("ingest_seq",) if c in pages.columns]
    return pages.select(*KEY, *more, F.posexplode(tokens(F.col("text"))).alias("pos", "token")).select("token", *KEY, "pos", *more)


def _bucket(token) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_index(store: Store, name: str, pages: DataFrame) -> DataFrame:
    """The postings of pages (file_id, ingest_seq, page, text) as the next version of a table, by bucket and sorted by token."""
    piece = F.pmod(F.xxhash64("file_id"), F.lit(PIECES))
    rows = postings(pages).withColumn("bucket", _bucket(F.col("token")))
    store.replace(name, rows.repartition("bucket", piece).sortWithinPartitions("bucket", "token", "ingest_seq", "page", "pos"), ["bucket"])
    return store.read(name)


def replaced(index: DataFrame, pages: DataFrame) -> DataFrame:
    """The postings with those of the documents of pages replaced by what pages (file_id, ingest_seq, page, text) have now; blank pages have none."""
    rows = postings(pages)
    kept = index.join(pages.select("file_id").distinct(), "file_id", "left_anti")
    return kept.select(*rows.columns).unionByName(rows)


def pending(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Pages of the documents that have no postings yet: what a deferred build has to add."""
    return pages.join(index.select("file_id").distinct(), "file_id", "left_anti")


def quote_term(term: str | None) -> str:
    """A term with blanks or quotes as a phrase."""
    t = (term or "").strip()
    return '"' + t.replace('"', '""') + '"' if " " in t or '"' in t else t


def sanitize(query: str) -> str:
    """Tokens with special characters become phrases; operators and quoted tokens stay; a query that begins with a quote is left."""
    if not query or query.startswith('"'):
        return query
    keep = lambda t: t.upper() in OPERATORS or (t.startswith('"') and t.endswith('"')) or not _SPECIAL.search(t)
    return " ".join(t if keep(t) else '"' + t.replace('"', "") + '"' for t in query.split())


def fold_query(text: str) -> list[str]:
    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return [w for w in re.split(r"[^\w]+|_+", plain) if w]


def parse(query: str) -> tuple | None:
    """("phrase", words), ("and"|"or"|"not", left, right); None where the grammar has no such query.

    Terms side by side bind tightest, then NOT, AND, OR. NOT needs a left side; operators are upper case."""
    items = [("phrase", p) if q else ((w,) if w in OPERATORS - {"NEAR"} else ("phrase", w)) for q, p, w in re.findall(r'("([^"]*)")|(\S+)', query)]

    def level(seq: list, names: list[str]) -> tuple | None:
        if not seq:
            return None
        if not names:
            parts = [("phrase", fold_query(x[1])) for x in seq if len(x) == 2]
            return reduce(lambda a, b: ("and", a, b), parts) if len(parts) == len(seq) else None
        groups: list[list] = [[]]
        for x in seq:
            if x == (names[0],):
                groups.append([])
            else:
                groups[-1].append(x)
        made = [level(g, names[1:]) for g in groups]
        if any(m is None for m in made):
            return None
        return reduce(lambda a, b: (names[0].lower(), a, b), made)

    return level(items, ["OR", "AND", "NOT"])


def _phrases(tree: tuple) -> list[tuple[str, ...]]:
    return [tuple(tree[1])] if tree[0] == "phrase" else _phrases(tree[1]) + _phrases(tree[2])


def matches(index: DataFrame, tree: tuple) -> DataFrame:
    """Pages (file_id, ingest_seq, page) that match: one scan of the query's tokens, one aggregation by page."""
    phrases = list(dict.fromkeys(_phrases(tree)))
    words = sorted({w for p in phrases for w in p})
    found = index.where(F.col("token").isin(words))
    if "bucket" in index.columns:
        buckets = index.sparkSession.range(1).select(F.array(*[_bucket(F.lit(w)) for w in words]).alias("b")).first().b if words else []
        found = found.where(F.col("bucket").isin(buckets))
    placed = sorted({w for p in phrases if len(p) > 1 for w in p})
    name = {w: f"w{i}" for i, w in enumerate(words)}
    has = [F.max(F.col("token") == w).alias(name[w]) for w in words]
    at = [F.collect_list(F.when(F.col("token") == w, F.col("pos"))).alias(f"at_{name[w]}") for w in placed]
    by_page = found.groupBy(*KEY, "ingest_seq").agg(*has, *at) if words else found.select(*KEY, "ingest_seq").limit(0)

    def phrase(p: tuple[str, ...]) -> Column:
        if not p:
            return F.lit(False)
        every = F.lit(True)
        for w in p:
            every = every & F.col(name[w])
        if len(p) == 1:
            return every
        follows = lambda x: [F.array_contains(f"at_{name[w]}", x + i) for i, w in enumerate(p[1:], 1)]
        return every & F.exists(f"at_{name[p[0]]}", lambda x: reduce(lambda c, d: c & d, follows(x)))

    def test(t: tuple) -> Column:
        if t[0] == "phrase":
            return phrase(tuple(t[1]))
        left, right = test(t[1]), test(t[2])
        return left | right if t[0] == "or" else left & (right if t[0] == "and" else ~right)

    return by_page.where(test(tree)).select(*KEY, "ingest_seq")


def search(index: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """file_id, page, rank from 1 of the first limit matches in the order of ingest. A query outside the grammar finds nothing."""
    tree = parse(sanitize(query))
    hits = matches(index, tree) if tree else index.select(*KEY, "ingest_seq").limit(0)
    first = hits.orderBy("ingest_seq", "page").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("ingest_seq", "page"))).select(*KEY, "rank")  # limit rows


def find_in(meta: DataFrame, index: DataFrame, texts: DataFrame, query: str, most: int = 50) -> DataFrame:
    """file_id, page, kind, rank: the first 200 full-text hits, of these those in meta (the filtered catalog), the first `most` of them.

    Where there is none, the places of the query or its mask in the texts (id, text) of meta's documents, in the order of
    ingest (see mask_hits), page null."""
    mine = meta.select(F.col("id").alias("file_id"), "ingest_seq")
    hits = search(index, query).join(mine.select("file_id"), "file_id", "left_semi").orderBy("rank").limit(most)
    if hits.limit(1).count():
        return hits.select("file_id", "page", F.lit("text").alias("kind"), "rank")
    allowed = texts.join(mine.select(F.col("file_id").alias("id"), "ingest_seq"), "id")
    seen = mask_hits(allowed.select("id", "text"), query).join(mine.select(F.col("file_id").alias("id"), "ingest_seq"), "id")
    first = seen.orderBy("ingest_seq", "id", "nth").limit(most)
    rank = F.row_number().over(Window.orderBy("ingest_seq", "id", "nth"))  # `most` rows
    return first.select(F.col("id").alias("file_id"), F.lit(None).cast("int").alias("page"), F.col("mask").alias("kind"), rank.alias("rank"))


def rag_context(hits: DataFrame, texts: DataFrame, max_docs: int = 5, chars: int = 6000) -> DataFrame:
    """file_id, first (best rank), context: the first characters of the texts (file_id, text) of the first max_docs distinct documents of hits."""
    best = first_documents(hits, max_docs)
    return texts.join(F.broadcast(best), "file_id").select("file_id", "first", F.substring("text", 1, chars).alias("context"))


def first_documents(hits: DataFrame, most: int) -> DataFrame:
    """file_id, first: distinct documents of hits (file_id, rank) in the order of their best rank."""
    return hits.groupBy("file_id").agg(F.min("rank").alias("first")).orderBy("first", "file_id").limit(most)


def snippets(hits: DataFrame, pages: DataFrame, words: list[str], around: int = 16) -> DataFrame:
    """hits with an excerpt of 2 * around tokens of the page's text about the first word that matches, marked."""
    text = F.split("text", r"\s+")
    joined = hits.join(pages.select(*KEY, "text"), KEY)
    clean = F.transform(text, lambda w: F.translate(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), ACCENTED, PLAIN))
    at = F.array_position(F.transform(clean, lambda w: w.isin(words)), F.lit(True))
    lo = F.greatest(at - around, F.lit(1)).cast("int")
    marked = F.transform(F.slice(text, lo, 2 * around), lambda w: F.when(F.translate(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), ACCENTED, PLAIN).isin(words), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return joined.select(*hits.columns, F.array_join(marked, " ").alias("snippet"))


def fuse(lists: list[tuple[DataFrame, float]], key: list[str], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (key, rank): one aggregation over their union."""
    every = reduce(DataFrame.unionByName, [d.select(*key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for d, w in lists])
    return every.groupBy(*key).agg(F.sum("part").alias("score"))


def mask_hits(texts: DataFrame, term: str | None = None) -> DataFrame:
    """texts (id, text) to id, mask, start, end, matched (code points, end exclusive), in Arrow batches over whole texts.

    First every place of term in any case (mask "term"), then the masks that term is an alias of, each place of them; if it is
    none, or without a term, all masks in their order, a span only for the first mask that matches it."""
    alias = (term or "").lower().strip()
    chosen = [alias] if alias in MASKS else ALIASES.get(alias)
    patterns = {k: MASKS[k] for k in chosen or MASKS}

    def find(batch: pd.Series) -> pd.Series:
        compiled = {k: re.compile(p) for k, p in patterns.items()}
        literal = re.compile(re.escape(term), re.IGNORECASE) if term else None
        rows = []
        for text in batch:
            found, seen = [], set()
            for m in literal.finditer(text or "") if literal else ():
                found.append({"mask": "term", "start": m.start(), "end": m.end(), "matched": m[0]})
            for k, p in compiled.items():
                for m in p.finditer(text or ""):
                    if chosen or m.span() not in seen:
                        seen.add(m.span())
                        found.append({"mask": k, "start": m.start(), "end": m.end(), "matched": m[0]})
            rows.append(found)
        return pd.Series(rows, dtype=object)

    places = F.pandas_udf(find, "array<struct<mask:string,start:int,end:int,matched:string>>")
    return texts.select("id", F.posexplode(places("text")).alias("nth", "h")).select("id", "nth", "h.*")


def with_synonyms(query: str, synonyms: dict[str, str]) -> str:
    """query with each bare term that has a synonym as "term OR synonym"; operators and phrases stay."""
    quoted = lambda w: f'"{w}"' if " " in w else w
    known = {k.strip().lower(): v.strip() for k, v in synonyms.items() if k.strip() and v.strip()}
    terms = re.findall(r'"[^"]*"|\S+', query)
    hit = [t for t in terms if t.lower() in known and t not in OPERATORS]
    return " OR ".join([query] + [" ".join(quoted(known[u.lower()]) if u == t else u for u in terms) for t in dict.fromkeys(hit)])
