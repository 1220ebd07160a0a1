"""Extractors over a few literal rows and what each must give: (name, SQL of the rows, query). The registered queries run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, dates, entities, forensics, formulas, signatures, structure, text
from foliant.operators import fulltext, records

LITERAL: dict = {}


def query(name: str, sql: str):
    def add(f):
        LITERAL[name] = (sql, f)
        return f

    return add


# Literal rows for extractors whose entities the tables lack; the same in both dialects.
CASES = {
    1: "CPF 111.444.777-35 e 123.456.789-00, CNPJ 11.222.333/0001-81, ana@example.com e bob@test.org, 192.168.1.1",
    2: "Contratante: ACME Ltda\nContratada: Joao Silva\nvalor R$ 10.000,00 e USD 5.000 e R$ 10.000,00",
    3: "Vencimento: 31/12/2025. Renovação automática. Processo 1234567-89.2024.8.26.0100 CEP 01310-100",
    4: "Vigência: de 01/03/2025 a 28/02/2026",
    5: "SECRET\nreport of 2024-03-15T14:30:00 and 15/06/2025 and 2024-02-30",
    6: "plain words only",
    7: "Prazo: 2 anos. Início: 31/01/2025",
    8: "DECLASSIFIED\nSECRET",
    9: "Classificação: CONFIDENCIAL http://example.com/a?b=1, see https://x.com/user1 and AB12 ABC-1234",
    10: "12/07/2026 e 20 de março de 2024 e 5 May 2023",
}
_quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
CASE = "with c as (select * from (values " + ", ".join(f"({i}, {_quote(t)})" for i, t in CASES.items()) + ") as v(id, text))"
VALUES = CASE[len("with c as (") : -1]


def cases(spark: SparkSession) -> DataFrame:
    return spark.sql(VALUES)


def _pairs(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"cast({v} as double)" if isinstance(v, float) else f"{v}" if isinstance(v, int) else _quote(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


query("i19_cpf_check", _pairs([("111.444.777-35", True), ("111.111.111-11", False), ("123.456.789-00", False), ("11144477735", True), ("123", False)]) + " as v(value, ok)")(lambda s, d: s.createDataFrame([(x,) for x in ("111.444.777-35", "111.111.111-11", "123.456.789-00", "11144477735", "123")], "value string").select("value", entities.valid_cpf(F.col("value")).alias("ok")))
query("i20_cnpj_check", _pairs([("11.222.333/0001-81", True), ("11.222.333/0001-82", False), ("12.ABC.345/01DE-35", True), ("00000000000000", False)]) + " as v(value, ok)")(lambda s, d: s.createDataFrame([(x,) for x in ("11.222.333/0001-81", "11.222.333/0001-82", "12.ABC.345/01DE-35", "00000000000000")], "value string").select("value", entities.valid_cnpj(F.col("value")).alias("ok")))
query("i22_entities", _pairs([(1, "ana@example.com,bob@test.org", "111.444.777-35", "11.222.333/0001-81", "192.168.1.1", "", ""), (3, "", "", "", "", "01310-100", "1234567-89.2024.8.26.0100")]) + " as v(id, emails, cpfs, cnpjs, ips, ceps, processos)")(lambda s, d: cases(s).where("id in (1, 3)").select("id", *[F.array_join(c, ",").alias(k) for k, c in entities.entities(F.col("text")).items() if k in ("emails", "cpfs", "cnpjs", "ips", "ceps", "processos")]))
query("i23_money", _pairs([(2, "BRL R$ 10.000,00;USD USD 5.000")]) + " as v(id, money)")(lambda s, d: cases(s).where("id = 2").select("id", F.array_join(F.transform(entities.money(F.col("text")), lambda m: F.concat_ws(" ", m["currency"], m["value_str"])), ";").alias("money")))
query("i24_parties", _pairs([(2, "ACME Ltda;Joao Silva")]) + " as v(id, parties)")(lambda s, d: cases(s).where("id = 2").select("id", F.array_join(entities.parties(F.col("text")), ";").alias("parties")))
query("i26_confidentiality", _pairs([(5, "SECRETO"), (6, None), (8, None), (9, "CONFIDENCIAL")]) + " as v(id, level)")(lambda s, d: cases(s).where("id in (5, 6, 8, 9)").select("id", entities.confidentiality(F.col("text")).alias("level")))
query("i28_document_type", _pairs([(2, "contrato", 0.27), (4, "contrato", 0.13), (6, "documento", 0.0)]) + " as v(id, label, confidence)")(lambda s, d: cases(s).where("id in (2, 4, 6)").select("id", classify.document_type(F.col("text")).alias("r")).select("id", "r.label", "r.confidence"))
query("i44_party_type", _pairs([("ACME Ltda", "org"), ("Maria da Silva", "person"), ("Fulano", "org")]) + " as v(name, type)")(lambda s, d: s.createDataFrame([("ACME Ltda",), ("Maria da Silva",), ("Fulano",)], "name string").select("name", entities.party_type(F.col("name")).alias("type")))
query("j1_dates", _pairs([(5, "2025-06-15,2024-02-30"), (6, ""), (10, "2026-07-12,2024-03-20,2023-05-05")]) + " as v(id, dates)")(lambda s, d: cases(s).where("id in (5, 6, 10)").select("id", F.array_join(dates.extract_dates(F.col("text")), ",").alias("dates")))
query("j3_contract_terms", _pairs([(3, None, "2025-12-31", None, True, 0.3333), (4, "2025-03-01", "2026-02-28", None, False, 0.6667), (6, None, None, None, False, 0.0), (7, "2025-01-31", "2027-01-31", 24, False, 0.6667)]) + " as v(id, start_date, end_date, duration_months, auto_renewal, confidence)")(lambda s, d: cases(s).where("id in (3, 4, 6, 7)").select("id", *[(F.round(c, 4) if k == "confidence" else c).alias(k) for k, c in dates.contract_terms(F.col("text")).items()]))
query("j2_parse_date", _pairs([("2025-06-15", "2025-06-15"), ("15/06/2025", "2025-06-15"), ("15 de junho de 2025", "2025-06-15"), ("01/02/49", "2049-02-01"), ("nada", None)]) + " as v(raw, iso)".replace("iso)", "parsed)"))(lambda s, d: s.createDataFrame([(x,) for x in ("2025-06-15", "15/06/2025", "15 de junho de 2025", "01/02/49", "nada")], "raw string").select("raw", dates.parse_date(F.col("raw"), 2050).alias("parsed")))
query("j5_pdf_date", _pairs([("D:20230615120000", "2023-06-15"), ("D:20231315", None)]) + " as v(raw, parsed)")(lambda s, d: s.createDataFrame([("D:20230615120000",), ("D:20231315",)], "raw string").select("raw", dates.pdf_date(F.col("raw")).alias("parsed")))


@query("j23_forensics", _pairs([(1, 60, "creation_after_modification,producer_creator_mismatch", "medium"), (2, 10, "missing_timezone,empty_author", "low"), (3, 0, "", "low")]) + " as v(id, score, anomalies, level)")
def j23(s, d):
    rows = [(1, "D:20240102000000Z", "D:20240101000000Z", "Microsoft Word", "GPL Ghostscript 9", "ana"), (2, "D:20240101000000", "D:20240102000000", "x", "y", ""), (3, "D:20240101000000+02'00'", "D:20240102000000Z", "x", "y", "ana")]
    df = s.createDataFrame(rows, "id int, created string, modified string, creator string, producer string, author string")
    a = df.select("id", forensics.anomalies(*[F.col(c) for c in ("created", "modified", "creator", "producer", "author")]).alias("a"))
    score = forensics.risk_score(F.col("a"))
    return a.select("id", score.alias("score"), F.array_join(F.transform("a", lambda x: x["type"]), ",").alias("anomalies"), forensics.risk_level(score).alias("level"))


MATHS = [
    (1, "$E = mc^2$ and $5,00 to $2024 and $$\\int x$$"),
    (2, "\\[a+b\\] \\begin{equation}y=x\\end{equation}"),
    (3, "the price is $5 for one and then $6 for two"),
    (4, "α + β ≤ γ; ok"),
    (5, "plain words only"),
]


def maths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"f{i}", 1, t) for i, t in MATHS], "file_id string, page int, text string")


query("i36_latex", _pairs([("α≤∞", "\\alpha \\le \\infty"), ("x ± y", "x \\pm y"), ("90°", "90^{\\circ}"), ("", "")]) + " as v(raw, latex)")(lambda s, d: s.createDataFrame([(x,) for x in ("α≤∞", "x ± y", "90°", "")], "raw string").select("raw", formulas.latex(F.col("raw")).alias("latex")))
query("i37_i38_formulas", _pairs([("f1", 1, "display", "\\int x"), ("f1", 2, "inline", "E = mc^2"), ("f1", 3, "inline", "5,00 to"), ("f2", 1, "environment", "y=x"), ("f2", 2, "display", "a+b"), ("f4", 1, "unicode_heuristic", "\\alpha + \\beta \\le \\gamma")]) + " as v(file_id, nth, kind, latex)")(lambda s, d: formulas.page_hits(maths(s)).select("file_id", "nth", "kind", "latex"))
query("e21_formula_counts", _pairs([("f1", "display", 1), ("f1", "inline", 2), ("f2", "display", 1), ("f2", "environment", 1), ("f4", "unicode_heuristic", 1)]) + " as v(file_id, kind, n)")(lambda s, d: formulas.counts(formulas.page_hits(maths(s))).select("file_id", "kind", F.col("n").cast("int").alias("n")))
query("i39_formula_section", _pairs([("f4", "## Fórmulas detectadas\n\nTotal: **1** (\nunicode_heuristic: 1\n)\n\n- Página 1 (unicode_heuristic):\n\n  $$ \\alpha + \\beta \\le \\gamma $$\n")]) + " as v(file_id, section)")(lambda s, d: formulas.markdown(formulas.page_hits(maths(s))).where("file_id = 'f4'"))
query("j24_near_black", _pairs([(1, True), (2, True), (3, False), (4, False), (5, False)]) + " as v(id, black)")(lambda s, d: s.createDataFrame([(1, [0.0]), (2, [0.05, 0.0, 0.01]), (3, [0.0, 0.0, 0.2]), (4, None), (5, [0.0, 0.0])], "id int, fill array<double>").select("id", structure.near_black(F.col("fill")).alias("black")))


@query("j33_redactions", _pairs([(1, 0, False, "sem redacções detectadas"), (2, 3, True, '2 zonas negras em 1 página; 1 anotação /Redact'), (3, 8, True, 'texto invisível detectado; camada(s) OCG oculta(s): "a", "b", "c" (+1 mais)')]) + " as v(id, zones, suspicious, summary)")
def j33(s, d):
    box, small = ([0.0], [0.0, 0.0, 100.0, 10.0]), ([0.0], [0.0, 0.0, 10.0, 10.0])
    rows = [(1, [([small], [("seen", 0, 0)], [])], []), (2, [([box, box], [], [("Redact",), ("Note",)]), ([], [], [])], [("x", True)]), (3, [([], [("ab", 0xFFFFFF, 0), ("cd", 0, 0x40)], [])], [(n, False) for n in "abcd"])]
    kinds = "id int, pages array<struct<drawings:array<struct<fill:array<double>,rect:array<double>>>,spans:array<struct<text:string,color:int,flags:int>>,annotations:array<struct<kind:string>>>>, layers array<struct<name:string,on:boolean>>"
    found = structure.redactions(F.col("pages"), F.col("layers"))
    return s.createDataFrame(rows, kinds).select("id", *[c.alias(k) for k, c in found.items()])


PROFILES = [(1, 0.0, 0.0, 0.0, 0.0, "", "", True), (2, 60.0, 0.0, 21.0, 0.0, "", "", False), (3, 5.0, 1.0, 0.0, 0.5, "ABBYY", "", False), (4, 300.0, 1.0, 0.0, 0.5, "", "D:1950", False), (5, 0.0, 1.0, 6.0, 0.7, "", "", False), (6, 0.0, 1.0, 0.0, 0.7, "", "", False), (7, 250.0, 0.0, 0.0, 0.1, "", None, False), (8, 60.0, 1.0, 0.0, 0.5, None, "", False), (9, 5.0, 1.0, 0.0, 0.1, "", "", False), (10, 60.0, 0.0, 0.0, 0.1, "", "", False), (11, 0.0, 0.0, 0.0, 0.0, "", "", False)]


def profiles(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(PROFILES, "id int, chars double, images double, drawings double, cover double, producer string, created string, forms boolean")
    return df.select("id", structure.document_kind(*[F.col(c) for c in df.columns[1:]]).alias("k")).select("id", "k.*")


KINDS = [(1, "form", 0.9), (2, "table_heavy", 0.7), (3, "historical_manuscript", 0.65), (4, "historical_print", 0.7), (5, "scanned_noisy", 0.7), (6, "scanned_clean", 0.8), (7, "born_digital", 0.9), (8, "hybrid_ocr", 0.75), (9, "image_only", 0.6), (10, "mixed", 0.5), (11, "unknown", 0.3)]
query("i41_document_kind", _pairs(KINDS) + " as v(id, kind, confidence)")(lambda s, d: profiles(s))
query("i42_ingest_advice", _pairs([(i, k, k in ("scanned_noisy", "scanned_clean", "image_only", "historical_print", "historical_manuscript"), "historical" if "historical" in k else "standard" if k in ("scanned_noisy", "scanned_clean", "image_only") else "none", k == "form", k == "table_heavy", k == "historical_manuscript") for i, k, _ in KINDS]) + " as v(id, kind, needs_ocr, ocr_mode, extract_forms, extract_tables, use_htr)")(lambda s, d: profiles(s).select("id", "kind", structure.advice(F.col("kind"), F.lit(False)).alias("a")).select("id", "kind", "a.needs_ocr", "a.ocr_mode", "a.extract_forms", "a.extract_tables", "a.use_htr"))

query("i21_domain_check", _pairs([("example.com", True), ("in.my", False), ("abc.io", False), ("abcd.io", True), ("www.abc.com", True), ("a-b-c-d.com", False), ("x.y.z.a.b.com", False), ("-abc.com", False), ("site.de-15.com", False)]) + " as v(value, ok)")(lambda s, d: s.createDataFrame([(x,) for x in ("example.com", "in.my", "abc.io", "abcd.io", "www.abc.com", "a-b-c-d.com", "x.y.z.a.b.com", "-abc.com", "site.de-15.com")], "value string").select("value", entities.valid_domain(F.col("value")).alias("ok")))
MORE = {1: "veja Avww.dominio.org, mail a@b.example.com, http://x.net/a e portal.gov.br", 2: "tel (11) 98765-4321 ou +55 11 3333-4444; RG nº 12.345.678-X", 3: "Protocolo nº 2024/001, Lei nº 8.666/93, -23.5505, -46.6333 e 99.12345, 10.12345", 4: "placas ABC-1234 e JAN-2024 e XYZ1A23"}
SEEN = {1: ("domains", "www.dominio.org,portal.gov.br"), 2: ("phones", "(11) 98765-4321,+55 11 3333-4444"), 3: ("coordenadas", "-23.5505, -46.6333"), 4: ("placas", "ABC-1234,XYZ1A23")}


def seen(spark: SparkSession) -> DataFrame:
    found = entities.entities(F.col("text"))
    rows = spark.createDataFrame(list(MORE.items()), "id int, text string")
    return rows.select("id", *[F.array_join(found[k], ",").alias(k) for k in ("domains", "phones", "coordenadas", "placas", "rgs", "protocolos", "leis")])


query("i16_i22_more_entities", _pairs([(1, "www.dominio.org,portal.gov.br", "", "", "", "", "", ""), (2, "", "(11) 98765-4321,+55 11 3333-4444", "", "", "12.345.678-X", "", ""), (3, "", "", "-23.5505, -46.6333", "", "", "Protocolo nº 2024/001", "Lei nº 8.666/93"), (4, "", "", "", "ABC-1234,XYZ1A23", "", "", "")]) + " as v(id, domains, phones, coordenadas, placas, rgs, protocolos, leis)")(lambda s, d: seen(s))
query("i25_tags", _pairs([(1, "contrato,serviço"), (2, "fiscal"), (3, "")]) + " as v(id, tags)")(lambda s, d: s.createDataFrame([(1, "contrato", "Prestação de serviços"), (2, "documento", "Imposto e ICMS"), (3, None, "nada")], "id int, t string, text string").select("id", F.array_join(entities.tags(F.col("t"), F.col("text")), ",").alias("tags")))
query("i1_normalize_text", _pairs([("a–b", "a-b"), (" a \t b ", "a b"), ("a\n\n\n\nb", "a\n\nb")]) + " as v(raw, t)")(lambda s, d: s.createDataFrame([(x,) for x in ("a–b", " a \t b ", "a\n\n\n\nb")], "raw string").select("raw", text.normalize_text(F.col("raw")).alias("t")))
query("g5_ceps", _pairs([(3, "01310100")]) + " as v(id, ceps)")(lambda s, d: s.createDataFrame([(3, "CEP 01310-100 e 01310-100")], "id int, text string").select("id", F.array_join(F.transform(entities.found(F.col("text"), entities.ENTITIES["ceps"]), lambda c: F.regexp_replace(c, r"\D", "")), ",").alias("ceps")))


@query("i40_unified_diff", _pairs([("a\nb", "a\nb\nc", 1, 0, False, "--- a\n+++ b\n@@ -1,2 +1,3 @@\n a\n b\n+c"), ("x", "x", 0, 0, True, "")]) + " as v(a, b, additions, deletions, identical, diff)")
def i40(s, d):
    return records.unified_diff(s.createDataFrame([("a\nb", "a\nb\nc"), ("x", "x")], "a string, b string")).select("a", "b", "additions", "deletions", "identical", F.array_join("unified", "\n").alias("diff"))


# Forensics of files, dates

SCANS = [
    (1, "D:20240101000000Z", "x", "<xmp:CreateDate>2024-01-03T00:00:00+02:00</xmp:CreateDate>", "1.4", ["Arial"], 10, 10_240),
    (2, "D:20240101000000Z", "MyScan 2", "<xmp:CreateDate>2024-01-01T12:00:00Z</xmp:CreateDate>", "1.3", ["ABC+Helvetica"], 10, 10_240),
    (3, None, None, None, None, None, 600, 10_240),
    (4, "D:20240101000000Z", "x", "", "1.7", [], 10, 0),
]


@query("j14_j21_scan_forensics", _pairs([(1, "xmp_docinfo_date_conflict", 40, "1 anomalia detectada (risco médio)"), (2, "pdf_version_anachronism,text_fonts_in_scanned_document", 40, "2 anomalias detectadas (risco médio)"), (3, "high_xref_ratio", 5, "1 anomalia detectada (risco baixo)"), (4, "", 0, "Nenhuma anomalia detectada.")]) + " as v(id, anomalies, score, summary)")
def j14(s, d):
    df = s.createDataFrame(SCANS, "id int, created string, producer string, xmp string, version string, fonts array<string>, n_objects int, file_size long")
    found = df.select("id", forensics.scan_anomalies(*[F.col(c) for c in df.columns[1:]]).alias("a"))
    score = forensics.risk_score(F.col("a"))
    return found.select("id", F.array_join(F.transform("a", lambda x: x["type"]), ",").alias("anomalies"), score.alias("score"), forensics.summary(F.col("a"), score).alias("summary"))


strings = lambda s, rows: s.createDataFrame([(x,) for x in rows], "raw string")
XMP = ["2024-03-15T12:00:00+02:00", "2024-03-15", "2024-02-30", "15/03/2024"]
query("j13_xmp_dates", _pairs(list(zip(XMP, ["2024-03-15 10:00:00", "2024-03-15 00:00:00", None, None]))) + " as v(raw, utc)")(lambda s, d: strings(s, XMP).select("raw", F.date_format(forensics.xmp_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc")))
SHOWN = ["D:20240315120000+00'00'", "D:20240315", "D:20240230", "D:20241399", "2024"]
query("j11_shown_pdf_dates", _pairs(list(zip(SHOWN, ["15/03/2024 12:00", "15/03/2024", None, None, None]))) + " as v(raw, shown)")(lambda s, d: strings(s, SHOWN).select("raw", dates.shown_pdf_date(F.col("raw")).alias("shown")))
ANY = ["D:20230615", "2023-06-15", "15 de junho de 2023", "15/06/23", "nada"]
query("j6_j7_j8_j9_any_date", _pairs(list(zip(ANY, ["2023-06-15"] * 4 + [None]))) + " as v(raw, parsed)")(lambda s, d: strings(s, ANY).select("raw", dates.any_date(F.col("raw")).alias("parsed")))
query("j4_months", _pairs([(2, "anos", 24), (45, "dias", 1), (5, "dias", 1), (7, "meses", 7)]) + " as v(n, unit, months)")(lambda s, d: s.createDataFrame([(2, "anos"), (45, "dias"), (5, "dias"), (7, "meses")], "n int, unit string").select("n", "unit", dates.months(F.col("n"), F.col("unit")).alias("months")))

MASKED = [(1, "ip 10.0.0.1, a@b.com e b.com"), (2, "11144477735"), (3, None)]
masked = lambda s, term: fulltext.mask_hits(s.createDataFrame(MASKED, "id int, text string"), term)
HIT = " as v(id, nth, mask, start, \"end\", matched)"
query("c8_masks", _pairs([(1, 0, "ipv4", 3, 11, "10.0.0.1"), (1, 1, "email", 13, 20, "a@b.com"), (1, 2, "domain", 15, 20, "b.com"), (1, 3, "domain", 23, 28, "b.com"), (2, 0, "cpf", 0, 11, "11144477735")]) + HIT)(lambda s, d: masked(s, None))
query("c9_c10_term_and_mask", _pairs([(1, 0, "term", 0, 2, "ip"), (1, 1, "ipv4", 3, 11, "10.0.0.1")]) + HIT)(lambda s, d: masked(s, "IP"))
query("h7_synonyms", _pairs([("carro AND azul", "carro AND azul OR automovel AND azul"), ("casa", "casa")]) + " as v(query, rewritten)")(lambda s, d: s.createDataFrame([(q, fulltext.with_synonyms(q, {"Carro": "automovel"})) for q in ("carro AND azul", "casa")], "query string, rewritten string"))

query("h2_sanitized", _pairs([("a.b AND c", '"a.b" AND c'), ('"x y" z*', '"x y" z*'), ("foo-bar baz", '"foo-bar" baz')]) + " as v(raw, sanitized)")(lambda s, d: s.createDataFrame([(q, fulltext.sanitize(q)) for q in ("a.b AND c", '"x y" z*', "foo-bar baz")], "raw string, sanitized string"))
query("i6_agreement", _pairs([(1, 1.0), (2, 0.5), (3, 0.0), (4, 0.0)]) + " as v(id, share)")(lambda s, d: s.createDataFrame([(1, [1, 2], [1, 2]), (2, [1, 2], [1, 3]), (3, [1], [1, 2]), (4, [], [])], "id int, a array<long>, b array<long>").select("id", signatures.agreement(F.col("a"), F.col("b")).alias("share")))


SAVED = "name string, query string, options map<string,string>, created_at double, updated_at double, last_run_at double, last_seen_ids array<string>"


def saved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", "alpha", {}, 1.0, 1.0, 2.0, ["x"]), ("b", "beta", {}, 1.0, 3.0, None, [])], SAVED)


def more(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", "gamma", None), ("c", "delta", {"k": "v"})], "name string, query string, options map<string,string>")


SAVED_ROWS = "select * from (values {}) as v(name, query, created_at, updated_at, seen)"
shown = lambda df: df.select("name", "query", "created_at", "updated_at", F.size("last_seen_ids").alias("seen"))
query("k10_save_searches", SAVED_ROWS.format("('a', 'gamma', 1.0::double, 9.0::double, 0), ('b', 'beta', 1.0, 3.0, 0), ('c', 'delta', 9.0, 9.0, 0)"))(lambda s, d: shown(records.save_searches(saved(s), more(s), 9.0)))
query("k10_save_new_searches", SAVED_ROWS.format("('a', 'alpha', 1.0::double, 1.0::double, 1), ('b', 'beta', 1.0, 3.0, 0), ('c', 'delta', 9.0, 9.0, 0)"))(lambda s, d: shown(records.save_searches(saved(s), more(s), 9.0, overwrite=False)))
query("k11_saved_search", SAVED_ROWS.format("('b', 'beta', 1.0::double, 3.0::double, 0)"))(lambda s, d: shown(saved(s).where("name = 'b'")))
query("k12_delete_search", SAVED_ROWS.format("('b', 'beta', 1.0::double, 3.0::double, 0)"))(lambda s, d: shown(records.without_searches(saved(s), saved(s).where("name = 'a'"))))


@query("k15_k16_grants", "select * from (values ('ana', 'f1,f3', 'f2'), ('bob', '', 'f1'), ('eva', '*', '')) as v(\"user\", allowed, deny)")
def k15(s, d):
    acl = s.createDataFrame([("ana", ["f1", "f2"], ["f3"]), ("eva", ["*"], [])], "user string, allowed array<string>, deny array<string>")
    changes = s.createDataFrame([(1, "ana", "f3", False), (2, "ana", "f3", True), (3, "ana", "f2", False), (4, "bob", "f1", True), (5, "bob", "f1", False)], "seq int, user string, file_id string, granted boolean")
    return records.changed_grants(acl, changes).select("user", F.array_join("allowed", ",").alias("allowed"), F.array_join("deny", ",").alias("deny"))


@query("d16_line_changes", "select * from (values (1, 1::bigint, 0::bigint, false), (2, 0, 1, false), (3, 0, 0, true), (4, 1, 0, false)) as v(page, additions, deletions, identical)")
def d16(s, d):
    a = s.createDataFrame([(1, "a\nb"), (2, "a\nb\nc"), (3, "same")], "page int, text string")
    b = s.createDataFrame([(1, "a\nb\nc"), (2, "a\nc"), (3, "same"), (4, "new")], "page int, text string")
    return records.line_changes(a, b)
