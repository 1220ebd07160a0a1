"""Storage, configuration, streaming flows, exports and rules that no query over the tables covers."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.functions import entities, gazetteer, signatures, text
from foliant.operators import analytics, fulltext, records, reports, semantic, similar
from foliant.sources import pdf, pdf_writer, readers, writers
from foliant.storage import Store
from foliant.streaming import flows

SF = "/root/testdata/sf0.001"


def test_store_versions_and_repair(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}", keep=2)
    for n in range(4):
        kept.replace("t", spark.range(n + 1))
    assert kept.versions("t") == [3, 4] and kept.read("t").count() == 4 and kept.read("t", 3).count() == 3
    kept.replace("t", kept.read("t").where("id > 0"))  # reads the version that it replaces
    assert kept.read("t").count() == 3
    with pytest.raises(FileNotFoundError):
        kept.read("t", 1)
    for f in tmp_path.glob("t/v00000005/*.parquet"):
        f.write_bytes(b"broken")
    for f in tmp_path.glob("t/v00000005/.*.crc"):
        f.unlink()
    assert kept.ensure("t", lambda: spark.range(7)).count() == 7
    (tmp_path / "t" / "v00000009").mkdir()  # a write that didn't end
    assert kept.versions("t")[-1] == 6


def test_options(tmp_path):
    (tmp_path / "a.toml").write_text("[search]\nlimit = 5\nlang = 'pt'\n")
    (tmp_path / "a.json").write_text(json.dumps({"Search": {"limit": 6}}))
    env = {"FOLIANT_SEARCH_LIMIT": "9", "FOLIANT_NAME": "x y", "OTHER": "1"}
    assert config.load(tmp_path / "a.toml", environ={}) == {"search_limit": 5, "search_lang": "pt"}
    assert config.load(tmp_path / "a.toml", environ=env) == {"search_limit": 9, "search_lang": "pt", "name": "x y"}
    assert config.load(tmp_path / "a.json", environ={}) == {"search_limit": 6} and config.load(tmp_path / "none", environ={}) == {}


def test_watch_of_files(spark, tmp_path):
    folder, seen = tmp_path / "in" / "deep", []
    folder.mkdir(parents=True)
    run = lambda: flows.watch_files(spark, str(tmp_path / "in"), lambda batch, n: seen.extend(r.path for r in pdf.read_pdf(batch.select("path", "content")).where("status = 'ok'").collect()), str(tmp_path / "log")).awaitTermination()
    (folder / "a.pdf").write_bytes(pdf_writer.pdf_bytes(["x"]))
    (folder / "b.txt").write_text("no")
    run()
    (folder / "c.pdf").write_bytes(pdf_writer.pdf_bytes(["y"]))
    run()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.pdf", "c.pdf"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in flows.listing(spark, str(tmp_path / "in")).collect()) == ["a.pdf", "c.pdf"]


def test_changed_files_forget_deleted_ones(spark):
    t = [datetime(2025, 1, d) for d in (1, 2)]
    frame = lambda rows, kind: spark.createDataFrame(rows, f"path string, {kind}")
    now = frame([("same", t[0], 5), ("newer", t[1], 5), ("grows", t[1], 6), ("new", t[1], 1)], "modificationTime timestamp, length long")
    before = frame([("same", t[0], 5), ("newer", t[1], 5), ("grows", t[1], 5), ("new", t[1], 1), ("gone", t[0], 1)], "modificationTime timestamp, length long")
    done = frame([("same", t[0]), ("newer", t[0]), ("gone", t[0])], "modificationTime timestamp")
    todo, left = flows.changed_files(now, before, done)
    assert {r.path for r in todo.collect()} == {"newer", "new"} and {r.path for r in left.collect()} == {"same", "newer"}


def test_sinks_and_alerts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", datetime(2025, 1, 1)), (2, "b", datetime(2025, 1, 1)), (1, "a", datetime(2025, 1, 1))], "id int, what string, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    flows.audit_sink(stream, f"{tmp_path}/audit", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.json(f"{tmp_path}/audit").count() == 3
    flows.audit_sink(flows.new_alerts(stream, ["id"], "ts"), f"{tmp_path}/alerts", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/alerts").collect()) == [1, 2]


@pytest.mark.parametrize("kind", ["jsonl", "csv", "json", "parquet"])
def test_exports(spark, tmp_path, kind):
    meta = readers.catalog(spark.read.parquet(f"{SF}/documents.parquet")).limit(20)
    writers.export(meta, kind, f"{tmp_path}/{kind}")
    read = {"jsonl": spark.read.json, "json": spark.read.json, "csv": lambda p: spark.read.option("header", True).csv(p), "parquet": spark.read.parquet}[kind]
    assert {r.id for r in read(f"{tmp_path}/{kind}").select("id").collect()} == {r.id for r in meta.select("id").collect()}
    with pytest.raises(ValueError, match="unknown format"):
        writers.export(meta, "xml", f"{tmp_path}/x")


def test_index_json_is_one_document(spark, tmp_path):
    meta = spark.createDataFrame([(2, "b", 'say "x"'), (1, "a", None)], "ingest_seq long, id string, name string")
    for rows, n in ((meta, 2), (meta.where("false"), 0)):
        writers.write_index_json(rows, f"{tmp_path}/{n}")
        (file,) = (tmp_path / str(n)).glob("part-*")
        made = json.loads(file.read_text())
        assert made["version"] == 3 and [f["id"] for f in made["files"]] == ["a", "b"][:n]


def test_notes(spark):
    row = spark.createDataFrame([("x", 1, 'a/b "c".pdf', "p", 3, None, 9, "en", "2024-01-02T", ["t"], ["A", "B"], "s", "u")], "id string, ingest_seq int, name string, original_path string, num_pages int, doc_type string, word_count int, language string, indexed_at string, tags array<string>, parties array<string>, subject string, summary string")
    got = writers.note_rows(row).first()
    assert got.file == "a_b _c_.md" and 'parties:\n  - "A"\n  - "B"\n---\n\n## Assunto\n\ns\n\n## Sumário\n\nu\n\n## Metadados' in got.body and "tags:\n  - t\n" in got.body


def test_saved_search_runs_a_callers_search(spark):
    saved = spark.createDataFrame([("n", "q", {"k": "v"}, ["1"])], "name string, query string, options map<string,string>, last_seen_ids array<string>")
    found, new = reports.run_search(saved, "n", lambda q, o: spark.createDataFrame([(1, q + o["k"]), (2, q)], "id int, hit string"), "id")
    assert found.count() == 2 and [(r.id, r.hit) for r in new.collect()] == [("2", "q")]
    with pytest.raises(KeyError):
        reports.run_search(saved, "m", lambda q, o: saved, "name")


def test_terms_stop_words_and_pages(spark):
    assert [fulltext.quote_term(t) for t in (None, " a ", "a b", 'x"y')] == ["", "a", '"a b"', '"x""y"']
    assert {"the", "0001", "extra"} <= set(gazetteer.stop_words("EN_us", " Extra ,,")) and "não" in gazetteer.stop_words("xx")
    assert len({p[0] for p in gazetteer.PLACES}) > 120
    assert spark.range(1).select(text.normalize_ocr(F.lit(" a \t b\n\n\n\nc "))).first()[0] == "a b\n\nc"


STAMPS = [("СОВЕРШЕННО СЕКРЕТНО", "ULTRASSECRETO"), ("x\n绝密", "ULTRASSECRETO"), ("سري للغاية", "ULTRASSECRETO"), ("Segretissimo", "ULTRASSECRETO"), ("비밀", "SECRETO"), ("Nível de sigilo: سري", "SECRETO"), ("机密文件", "CONFIDENCIAL"), ("内部使用", "RESERVADO")]
STAMPS += [("Nível de sigilo: público", None), ("Classificação: público", "PÚBLICO"), ("a SECRET matter", None), ("Nível de sigilo - uso interno", None), ("uso interno", "USO INTERNO")]


def test_stamps_in_all_scripts(spark):
    df = spark.createDataFrame(STAMPS, "text string, level string")
    assert [r.text for r in df.select("*", entities.confidentiality(F.col("text")).alias("got")).where("not (got <=> level)").collect()] == []


def test_components_of_a_long_chain(spark):
    pairs = spark.range(1, 200).selectExpr("id - 1 as a", "id as b").union(spark.createDataFrame([(500, 501)], "a long, b long"))
    got = {r.node: r.component for r in similar.components(pairs).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def test_quantiles_of_skewed_groups(spark):
    rows = [("hot", float(i % 97)) for i in range(3000)] + [("b", 1.0), ("b", 3.0), ("b", None), (None, 2.0)]
    got = {(r.g, r.q): r.v for r in analytics.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.5, 1.0], ["g"]).collect()}
    by = {g: sorted(v for k, v in rows if k == g and v is not None) for g in ("hot", "b", None)}
    assert got == {(g, q): v[min(int(len(v) * q), len(v) - 1)] for g, v in by.items() for q in (0.0, 0.5, 1.0)}


def test_metrics_sums_are_exact_in_any_order(spark, tmp_path):
    from foliant.plans.extra import e20

    small, far = [0.000004] * 1000, 90000000000.0  # each is lost beside the large one
    rows = [("a", v) for v in [far, *small]] + [("b", v) for v in [*small, None, far]] + [("c", 1e300), ("c", 1e300), ("d", float("inf")), ("e", 9e19), ("e", 9e19), ("f", None)]
    spark.createDataFrame(rows, "event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {r.line for r in e20(spark, str(tmp_path)).collect()}
    assert {"a_sum 90000000000.004000", "b_sum 90000000000.004000", "e_sum 180000000000000000000.000000", "a_count 1001", "d_sum Infinity"} <= lines
    assert not any(x.startswith("f_") for x in lines) and len(f"{2e300:.0f}") == max(len(x.split(" ")[1].split(".")[0]) for x in lines if x.startswith("c_sum"))


def test_signature_bands_find_nearly_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), signatures.signature(F.col("text")).alias("signature"))
    pairs = lambda found: {(r.a, r.b) for r in found[0].collect()}
    exact, banded = pairs(signatures.all_pairs(docs, 0.75)), pairs(signatures.near_pairs(docs, 0.75))
    assert banded <= exact and len(banded) >= 0.9 * len(exact)


def test_page_differences(spark):
    a = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "same"), (2, 1, "gone")], "pair int, page int, text string")
    b = spark.createDataFrame([(1, 1, "a\nc\nd"), (1, 2, "same"), (3, 1, "new")], "pair int, page int, text string")
    got = {(r.pair, r.page): (r.additions, r.deletions, r.identical) for r in reports.page_differences(a, b, ["pair", "page"]).collect()}
    assert got == {(1, 1): (2, 1, False), (1, 2): (0, 0, True), (2, 1): (0, 1, False), (3, 1): (1, 0, False)}


def test_search_falls_back_to_documents(spark):
    meta = spark.createDataFrame([("a", "A", 1, "contrato", "en", "2024"), ("b", "B", 2, None, "pt", "2025")], "id string, name string, ingest_seq int, doc_type string, language string, indexed_at string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "file_id string, embedding array<float>")
    none = vectors.where("false").withColumn("page", F.lit(1))
    assert [(r.file_id, r.page, r.score) for r in semantic.find(none, vectors, meta, [1.0, 0.0]).orderBy("rank").collect()] == [("a", None, 1.0), ("b", None, 0.0)]
    chunks = vectors.withColumn("page", F.lit(2)).union(vectors.withColumn("page", F.lit(1)))
    assert [(r.file_id, r.page) for r in semantic.find(chunks, vectors, meta, [1.0, 0.0]).orderBy("rank").collect()] == [("a", 1), ("b", 1)]


def test_xmp_and_signatures(spark):
    xmp = "<x><dc:title><rdf:Alt><rdf:li xml:lang='x'>A &amp; B</rdf:li></rdf:Alt></dc:title><xmp:CreatorTool>Tool</xmp:CreatorTool><dc:subject><rdf:Bag><rdf:li>one</rdf:li><rdf:li> </rdf:li><rdf:li>two</rdf:li></rdf:Bag></dc:subject></x>"
    got = spark.range(1).select(pdf.xmp_fields(F.lit(xmp)).alias("x")).select("x.*").first()
    assert (got.dc_title, got.xmp_creator_tool, got.pdf_keywords, got.dc_subject, got.xml_length) == ("A & B", "Tool", None, ["one", "two"], len(xmp))
    body = {1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [3 0 R 4 0 R 6 0 R] >> >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 3: b"<< /T (s1) /FT /Sig /V 5 0 R >>", 4: b"<< /T (s2) /FT /Sig >>", 5: b"<< /Type /Sig /Name (Ana) >>", 6: b"<< /T (x) /FT /Tx /V (v) >>"}
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in body.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"
    row = pdf.read_pdf(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")).select(pdf.signatures(F.col("fields")).alias("s")).first()
    assert [tuple(x) for x in row.s] == [("s1", "Ana", True), ("s2", None, False)]


def test_highlights_and_snippets(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from foliant.plans.archive import queries

    got = {r.doc_id: r.snippet for r in queries()["f15_highlights"](spark, SF).collect()}
    for i, t in docs.items():
        m = re.search(r"(?<!\w)thing(?!\w)", t, re.IGNORECASE)
        assert (i in got) == bool(m)
        if m:
            a, b = max(0, m.start() - 60), min(len(t), m.end() + 60)
            assert got[i] == ("…" if a else "") + " ".join(t[a:b].split()) + ("…" if b < len(t) else "")
    for r in queries()["h4_snippets"](spark, SF).collect():
        assert "<mark>" in r.snippet and len(re.split(r"\s+", r.snippet)) <= 32


def test_newest_searches_and_cleared_rows(spark):
    saved = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, updated_at double")
    assert [r.name for r in records.newest_searches(saved).orderBy("rank").collect()] == ["b", "a"] and records.cleared(saved).count() == 0


def test_late_labels_and_shown_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "source string, target string, weight int")
    nodes = spark.createDataFrame([("a", "org"), ("b", "org"), ("c", "person")], "entity string, type string")
    assert analytics.without_dangling(edges, nodes).count() == 2 and [r.target for r in analytics.without_dangling(edges, nodes, ["org"]).collect()] == ["b"]
