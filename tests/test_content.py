"""PDF scans of hand-made files, formulas, diffs and exact signature pairs."""

import zlib

from pyspark.sql import functions as F

from foliant.functions import formulas, signatures, text
from foliant.operators import records
from foliant.sources import pdf, pdf_writer


def stream(body: bytes, head: bytes = b"", flate: bool = True) -> bytes:
    data = zlib.compress(body) if flate else body
    return b"<< %s /Length %d %s >>\nstream\n%s\nendstream" % (head, len(data), b"/Filter /FlateDecode" if flate else b"", data)


def made(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << %s >>\n%%%%EOF" % trailer


INNER = pdf_writer.pdf_bytes(["inner page"], "inner")
CMAP = b"1 beginbfchar <0001> <00e9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
CONTENT = b"""0 g 10 10 100 50 re f 1 1 1 rg 0 0 200 200 re f 0 g
BT /F1 12 Tf 50 700 Td (Hello \\(you\\)) Tj 14 TL T* [(wor) -20 (ld) -400 (again)] TJ ET
BT /F2 12 Tf 1 0 0 1 50 600 Tm <000100020004> Tj ET
BT /F1 9 Tf 3 Tr 50 100 Td (ghost) Tj ET q /Fm Do Q"""
RICH = {
    1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 9 0 R /AcroForm << /Fields [10 0 R] >> /Outlines << /First 12 0 R >> /Names << /EmbeddedFiles << /Names [(a.pdf) 13 0 R (b.txt) 15 0 R] >> >> /OCProperties << /OCGs [17 0 R] /D << /OFF [17 0 R] >> >> >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 300 800] /Rotate 90 >>",
    3: b"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F1 6 0 R /F2 7 0 R >> /XObject << /Fm 18 0 R /Im 19 0 R >> >> /Annots [20 0 R 21 0 R] >>",
    4: b"<< /Type /Page /Contents 22 0 R >>",
    5: stream(CONTENT),
    6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times#20Roman /Encoding << /Differences [1 /eacute /uni0416] >> >>",
    7: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 8 0 R >>",
    8: stream(CMAP),
    9: stream(b"<x:xmpmeta/>", flate=False),
    10: b"<< /T (group) /FT /Tx /Kids [11 0 R] >>",
    11: b"<< /T (name) /V <feff00e1> >>",
    12: b"<< /Title (One) /First << /Title (Two) >> /Next << /Title (Three) >> >>",
    13: b"<< /F (a.pdf) /EF << /F 14 0 R >> >>",
    14: stream(INNER),
    15: b"<< /F (b.txt) /EF << /F 16 0 R >> >>",
    16: stream(b"text"),
    17: b"<< /Type /OCG /Name (secret) >>",
    18: stream(b"BT /F1 9 Tf 50 50 Td (\\001\\002 form) Tj ET", b"/Subtype /Form"),
    19: stream(b"\0", b"/Subtype /Image /Width 3 /Height 4"),
    20: b"<< /Subtype /Link /A << /URI (http://e.org) >> >>",
    21: b"<< /Subtype /Redact /T (ana) /Contents (why) >>",
    22: b"<< /Length 4 /Filter /FlateDecode >>\nstream\nxxxx\nendstream",
    30: b"<< /Title (The \\351 title) >>",
}


def scanned(spark, *files):
    return pdf.read_pdf(spark.createDataFrame([(str(i), bytearray(f) if f is not None else None) for i, f in enumerate(files)], "path string, content binary"))


def test_structure(spark):
    file, inner = sorted(scanned(spark, made(RICH, b"/Root 1 0 R /Info 30 0 R")).collect(), key=lambda r: r.path)
    assert (file.status, file.num_pages, file.version, file.info, file.xmp) == ("ok", 2, "1.5", {"Title": "The é title"}, "<x:xmpmeta/>")
    first, second = file.pages
    assert first.text == "Hello (you)\nworld again\néac\nghost\néЖ form"
    assert (first.width, first.height, first.rotation, first.failed) == (300, 800, 90, False)
    assert second.failed and second.text is None
    assert [tuple(f) for f in first.fonts] == [("Times Roman", "Type1"), ("X", "Type0")]
    assert [tuple(i)[1:] for i in first.images] == [(3, 4)]
    assert first.links == ["http://e.org"] and [(a.kind, a.author, a.text) for a in first.annotations] == [("Redact", "ana", "why")]
    assert [d.rect for d in first.drawings if d.fill == [0.0]] == [[10, 10, 110, 60]]
    assert [s.text for s in first.spans if s.flags] == ["ghost", "éЖ form"]
    assert [tuple(f) for f in file.fields] == [("group.name", "Tx", "á", False)]
    assert [tuple(o) for o in file.outline] == [(1, "One"), (2, "Two"), (1, "Three")]
    assert [tuple(a) for a in file.attachments] == [("a.pdf", len(INNER), True), ("b.txt", 4, False)]
    assert [tuple(v) for v in file.layers] == [("secret", False)]
    assert (inner.path, inner.status, inner.pages[0].text) == ("0!a.pdf", "ok", "inner page")


def test_compressed_objects_and_later_definitions(spark):
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F1 6 0 R >> >> >>", 6: b"<< /Subtype /Type1 /BaseFont /A >>"}
    offsets, body = b"", b""
    for k, v in packed.items():
        offsets += b"%d %d " % (k, len(body))
        body += v + b" "
    objects = {4: stream(offsets + body, b"/Type /ObjStm /N 4 /First %d" % len(offsets)), 5: stream(b"BT /F1 1 Tf (old) Tj ET")}
    file = made(objects, b"/Root 1 0 R") + b"\n5 0 obj\n" + stream(b"BT /F1 1 Tf (new) Tj ET") + b"\nendobj"
    assert [r.pages[0].text for r in scanned(spark, file).collect()] == ["new"]


def test_files_that_are_none(spark):
    encrypted = made({1: b"<< /Type /Catalog >>"}, b"/Root 1 0 R /Encrypt << >>")
    got = {r.path: r.status for r in scanned(spark, None, b"", b"hello", encrypted, b"%PDF-1.4 nothing", INNER[:200]).collect()}
    assert got == {"0": "not a pdf", "1": "not a pdf", "2": "not a pdf", "3": "encrypted", "4": "broken", "5": "ok"}
    assert scanned(spark).count() == 0


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.PDF").write_bytes(pdf_writer.pdf_bytes(["α one", "", "two\nthree"]))
    (tmp_path / "y.txt").write_text("no")
    found = pdf.scan_pdf(spark, str(tmp_path))
    assert [r.t for r in found.select(pdf.full_text(F.col("pages")).alias("t")).collect()] == ["? one\n\ntwo\nthree"]
    assert [r.n for r in pdf.pdf_pages(found).orderBy("n").collect()] == [1, 2, 3]
    assert found.select(pdf.failed_pages(F.col("pages")).alias("f")).first().f == []


def test_columns(spark):
    rows = [([(300.0, 700.0, "r1"), (50.0, 700.0, "l1"), (52.0, 600.0, "l2"), (300.0, 600.0, "r2")], 600.0), ([], 600.0)]
    df = spark.createDataFrame(rows, "lines array<struct<x:double,y:double,text:string>>, width double")
    assert [r.t for r in df.select(pdf.column_text(F.col("lines"), F.col("width")).alias("t")).collect()] == ["l1\nl2\nr1\nr2", ""]


def test_formulas_of_nulls_and_long_prose(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, ""), ("c", 1, "word " * 40_000), ("d", 1, "x" * 200_000 + " = π²r")], "file_id string, page int, text string")
    assert formulas.page_hits(df).count() == 0
    twice = spark.createDataFrame([("e", 1, "α=β; sum ∑x=1, ∑y; SUM ∑X=1, ∑Y")], "file_id string, page int, text string")
    assert [r.raw for r in formulas.page_hits(twice).orderBy("nth").collect()] == ["sum ∑x=1, ∑y"]


def test_diff_of_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), ("a\nb", "b")], "a string, b string")
    assert [(r.additions, r.deletions, r.identical) for r in records.unified_diff(df).collect()] == [(0, 0, True), (1, 0, False), (0, 1, False)]


def test_all_pairs_of_signatures(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.randrange(1 << 60) for _ in range(128)]
    rows = [(i, [x if rnd.random() > i / 60 else rnd.randrange(1 << 60) for x in base]) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, signature array<long>")
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) / 128
    for t in (0.5, 0.75, 1.0):
        got = {(r.a, r.b) for r in signatures.all_pairs(df, t)[0].collect()}
        assert got == {(i, j) for i, x in rows for j, y in rows if i < j and alike(x, y) >= t}


def test_all_pairs_sends_few_signatures_and_meets_strangers_once(spark, monkeypatch):
    """Of classes with common bands only those that may agree enough are judged; a hot bucket is dealt into parts, its links into blocks."""
    import random

    rnd = random.Random(2)
    fresh = lambda: rnd.randrange(1 << 62)
    common, copied = [fresh() for _ in range(128)], [fresh() for _ in range(128)]
    strangers = [[c if i < 40 else fresh() for i, c in enumerate(common)] for _ in range(60)]  # ten common bands, 40 places
    copies = [[c if rnd.random() > 0.12 else fresh() for c in copied] for _ in range(60)]
    rows = [(f"k{i:03}", s) for i, s in enumerate([*strangers, *copies, copies[0], None])]
    df = spark.createDataFrame(rows, "id string, signature array<long>")
    monkeypatch.setattr(signatures, "BUCKET", 16)
    monkeypatch.setattr(signatures, "BLOCK", 8)
    least = df.where("signature is not null").groupBy("signature").agg(F.min("id").alias("class"))
    met = [tuple(r) for r in signatures._meetings(least, 128, 32).collect()]
    assert len(met) == len(set(met)) < 60 * 59 / 2 + 100 and all(a >= "k060" for a, _ in met)
    got = {(r.a, r.b): r.similarity for r in signatures.all_pairs(df, 0.75)[0].collect()}
    alike = {(i, j): sum(x == y for x, y in zip(a, b)) / 128 for i, a in rows[:120] for j, b in rows[:120] if i < j}
    assert got == {k: v for k, v in alike.items() if v >= 0.75} and len(got) > 500


def test_signatures_of_far_characters(spark):
    """Pieces of characters that fit no packed key, alone and among others, and a long text; each has the minima of all pieces."""
    import hashlib

    whole = lambda b: int.from_bytes(hashlib.sha256(b.encode()).digest()[:8], "little")
    texts = ["漢字" * 20, "abc 漢 defghijk lmnop qrstuv ß 𝒳 xyz", "w" * 30, " ".join(str(i * i) for i in range(3000)), " \n " + "a" * 19 + " \t", " \n " + "b" * 20 + " "]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(signatures.signature(F.col("t"), 128).alias("s"), text.normalize(F.col("t")).alias("n"), "id").collect()]
    normal = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(text.normalize(F.col("t")).alias("n")).collect()]
    seeds = [whole(f"minhash-seed-{i}") for i in range(128)]
    for i, (s, n) in enumerate(zip(got, normal)):
        pieces = {whole(n[j : j + 5]) for j in range(len(n) - 4)}
        assert (s is None) if i == 4 else [x % 2**64 for x in s] == [min(p ^ seed for p in pieces) for seed in seeds]


def test_masks_of_nulls_and_synonyms(spark):
    from foliant.operators import fulltext

    df = spark.createDataFrame([(1, None), (2, ""), (3, "Link http://a.org/x and LINK")], "id int, text string")
    got = [(r.id, r.mask, r.start, r.end) for r in fulltext.mask_hits(df, "link").orderBy("nth").collect()]
    assert got == [(3, "term", 0, 4), (3, "term", 24, 28), (3, "url", 5, 19)]
    assert fulltext.with_synonyms('a "b c"', {"a": "x y"}) == 'a "b c" OR "x y" "b c"'


def test_ingest_of_new_files_only(spark):
    from foliant.operators import ingest

    old, new = pdf_writer.pdf_bytes(["known text"]), pdf_writer.pdf_bytes(["SECRET\nthe report of the year"], "T")
    files = spark.createDataFrame([("a.pdf", bytearray(old)), ("c.pdf", bytearray(new)), ("b.pdf", bytearray(new)), ("d.pdf", None), ("e.pdf", bytearray(b"no"))], "path string, content binary")
    known = ingest.new_files(files.where("path = 'a.pdf'"), spark.createDataFrame([], "content_hash string")).count()
    assert known == 1
    from foliant.sources.readers import content_hash

    hashes = files.where("path = 'a.pdf'").select(content_hash(F.col("content")).alias("content_hash"))
    rows = ingest.ingest(files, hashes).collect()
    assert [(r.original_path, r.title, r.confidentiality, r.num_pages, r.pages_for_ocr) for r in rows] == [("b.pdf", "T", "SECRETO", 1, [1])]


def test_sealed_payloads(spark):
    from foliant.operators import ingest

    df = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b""),), (None,)], "p binary")
    key, wrong = F.lit("k" * 16).cast("binary"), F.lit("w" * 16).cast("binary")
    sealed = ingest.sealed(F.col("p"), key)
    got = df.select(ingest.opened(sealed, key).alias("o"), ingest.opened(sealed, wrong).alias("w"), ingest.opened(F.col("p"), key).alias("plain")).collect()
    assert [(r.o and bytes(r.o), r.w, r.plain and bytes(r.plain)) for r in got] == [(b"x", None, b"x"), (r1 := got[1].o, None, got[1].plain), (None, None, None)]
    assert bytes(r1) == b""
