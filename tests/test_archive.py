"""Every archive query with SQL gives DuckDB's rows on the smallest tables; literal cases of the expressions."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import catalog, fulltext, similar
from foliant.plans.archive import oracle_sql, queries
from tests.literal_cases import LITERAL

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders customer lineitem".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return d


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v


def same(duck, df, sql):
    want = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rows = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    same(duck, queries()[name](spark, SF), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(LITERAL))
def test_literal_cases(spark, duck, name):
    sql, f = LITERAL[name]
    same(duck, f(spark, SF), sql)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a b", ("and", ("phrase", ["a"]), ("phrase", ["b"]))),
        ("a OR b NOT c", ("or", ("phrase", ["a"]), ("not", ("phrase", ["b"]), ("phrase", ["c"])))),
        ("NOT a", None),
        ("a AND NOT b", None),
        ("and", ("phrase", ["and"])),
        ('"Ação não"', ("phrase", ["acao", "nao"])),
        ("192.168", ("phrase", ["192", "168"])),
    ],
)
def test_query_grammar(query, tree):
    assert fulltext.parse(fulltext.sanitize(query)) == tree


def test_search_outside_the_grammar_finds_nothing(spark):
    pages = spark.createDataFrame([("x", 1, 1, "a b")], "file_id string, ingest_seq int, page int, text string")
    assert fulltext.search(fulltext.postings(pages), "NOT a").count() == 0 and fulltext.search(fulltext.postings(pages), "a b").count() == 1


def test_entropy_and_names(spark):
    row = spark.createDataFrame([("aabb", "/x/ y.pdf")], "t string, p string").select(text.entropy(F.col("t")).alias("e"), text.display_name(F.col("p")).alias("n")).first()
    assert row.e == 1.0 and row.n == "y.pdf"


def test_access_rules(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    grants = spark.createDataFrame([("all", ["*"], ["b"])], "user string, allowed array<string>, deny array<string>")
    see = lambda user, default: [r.id for r in catalog.readable(ids, grants, user, default).orderBy("id").collect()]
    assert see("all", False) == ["a"] and see("nobody", True) == ["a", "b"] and see("nobody", False) == []


def test_no_vectors_no_pairs(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert similar.similar_pairs(none, 0.5).count() == 0
