"""Extractors over whole tables: the sample's documents, the literal cases as further rows, null and long texts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.functions import classify, entities, text
from foliant.plans.archive import queries
from foliant.plans.content import body, hits, over_documents
from tests.literal_cases import CASES

SF = "/root/testdata/sf0.001"
FIRST = 1_000_000
LONG = "filler words " * 20_000 + "\nContratante: Late Ltda\nmail late@example.org"
ONE_ROW_EACH = [n for n in "i16_i22_entities i23_money i24_parties i25_tags i26_confidentiality i28_document_type j1_dates j2_parse_date j6_j7_j8_j9_any_date j3_contract_terms i1_normalize_text i36_latex".split()]


PLAIN = {
    "i19_cpf_check": lambda s, d: hits(s, d, entities.mask(body(), "cpf")).withColumn("ok", entities.valid_cpf(F.col("value"))),
    "i20_cnpj_check": lambda s, d: hits(s, d, entities.mask(body(), "cnpj")).withColumn("ok", entities.valid_cnpj(F.col("value"))),
    "i23_money": lambda s, d: over_documents(s, d, money=entities.money(body())),
    "i24_parties": lambda s, d: over_documents(s, d, parties=entities.parties(body())),
    "i44_party_type": lambda s, d: hits(s, d, entities.parties(body())).withColumn("type", entities.party_type(F.col("value"))),
    "i25_tags": lambda s, d: over_documents(s, d, tags=entities.tags(classify.document_type(body())["label"], body())),
    "i26_confidentiality": lambda s, d: over_documents(s, d, level=entities.confidentiality(body())),
    "i28_document_type": lambda s, d: over_documents(s, d, r=classify.document_type(body())).select("doc_id", "r.*"),
    "i1_normalize_text": lambda s, d: over_documents(s, d, t=text.normalize_text(body())),
}


def run(name):
    return PLAIN.get(name) or queries()[name]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(FIRST + i, t) for i, t in CASES.items()] + [(FIRST, None), (FIRST + 99, LONG)], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    return {r.doc_id: r for r in run(name)(spark, sf).collect()}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_each_document(spark, sf, texts, name):
    assert sorted(r.doc_id for r in run(name)(spark, sf).collect()) == sorted(texts)


def cpf(value):
    d = [int(c) for c in re.sub(r"\D", "", value)]
    check = lambda n: (lambda t: 0 if t < 2 else 11 - t)(sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) % 11)
    return len(set(d)) > 1 and d[9] == check(9) and d[10] == check(10)


def distinct(text, pattern):
    return list(dict.fromkeys(m[0] for m in re.finditer(pattern, text)))


def test_entities_equal_regular_expressions(spark, sf, texts):
    got = rows(spark, sf, "i16_i22_entities")
    for i, t in texts.items():
        assert (got[i].emails or []) == distinct(t, entities.MASKS["email"])[:30]
        assert (got[i].cpfs or []) == [v for v in distinct(t, entities.MASKS["cpf"]) if cpf(v)][:30]
        assert (got[i].ceps or []) == distinct(t, entities.ENTITIES["ceps"])[:30]
    assert got[FIRST + 99].emails == ["late@example.org"] and sum(bool(r.emails) for r in got.values()) > 3
    checked = run("i19_cpf_check")(spark, sf).collect()
    assert sorted((r.doc_id, r.value, r.ok) for r in checked) == sorted((i, v, cpf(v)) for i, t in texts.items() for v in distinct(t, entities.MASKS["cpf"]))


def test_cases_among_documents(spark, sf):
    get = lambda name, i: rows(spark, sf, f"{name}")[FIRST + i]
    assert [(m.currency, m.value_str) for m in get("i23_money", 2).money] == [("BRL", "R$ 10.000,00"), ("USD", "USD 5.000")]
    assert get("i24_parties", 2).parties == ["ACME Ltda", "Joao Silva"] and get("i24_parties", 99).parties == ["Late Ltda"]
    levels = rows(spark, sf, "i26_confidentiality")
    assert [levels[FIRST + i].level for i in (5, 6, 8, 9, 0)] == ["SECRETO", None, None, "CONFIDENCIAL", None]
    assert (get("i28_document_type", 2).label, get("i28_document_type", 2).confidence) == ("contrato", 0.27)
    assert get("j1_dates", 10).dates == ["2026-07-12", "2024-03-20", "2023-05-05"]
    terms = rows(spark, sf, "j3_contract_terms")
    assert [(terms[FIRST + i].start_date, terms[FIRST + i].end_date) for i in (3, 4, 7)] == [(None, "2025-12-31"), ("2025-03-01", "2026-02-28"), ("2025-01-31", "2027-01-31")]


def test_hits_of_documents(spark, sf, texts):
    assert {(r.value, r.type) for r in run("i44_party_type")(spark, sf).collect()} >= {("ACME Ltda", "org"), ("Joao Silva", "person"), ("Late Ltda", "org")}
    for name in ("i20_cnpj_check", "i21_domain_check"):
        assert {r.doc_id for r in run(f"{name}")(spark, sf).collect()} >= {FIRST + 1}
    terms = queries()["c9_c10_term_and_mask"](spark, sf).where("mask = 'term'").groupBy("id").agg(F.count("*").alias("n")).collect()
    assert len(terms) > 50


def test_graph_has_every_mention(spark, sf, texts):
    words = {i: sorted({w for w in re.split("[^a-z]+", t.lower()) if len(w) == 5}) for i, t in texts.items()}
    assert max(map(len, words.values())) > 12
    edges = Counter((a, b) for ws in words.values() for n, a in enumerate(ws) for b in ws[n + 1 :])
    assert {(r.source, r.target): r.weight for r in queries()["d8_graph_edges"](spark, sf).collect()} == edges
    assert {(r.source, r.target) for r in queries()["d8_document_edges"](spark, sf).collect()} == {(f"doc:{i}", w) for i, ws in words.items() for w in ws}
    assert {r.entity: r.doc_count for r in queries()["e18_graph_nodes"](spark, sf).collect()} == Counter(w for ws in words.values() for w in ws)
