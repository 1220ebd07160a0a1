"""PDF files from page texts: exports and dossiers."""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, LEADING, LEFT, TOP = 10, 12, 40, 800


def pdf_bytes(pages: list[str], title: str = "") -> bytes:
    """One page for each text, a line for each of its lines, in Helvetica; characters outside Windows-1252 become "?".

    Lines aren't wrapped; those below the page's edge are there for readers of the text all the same."""
    hexed = lambda s: b"<" + s.encode("cp1252", "replace").hex().encode() + b">"
    n = len(pages)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n))),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Title %s >>" % (b"<feff" + title.encode("utf-16-be", "surrogatepass").hex().encode() + b">"),
    ]
    for i, text in enumerate(pages):
        shown = b"\n".join(hexed(line) + b" Tj T*" for line in text.split("\n"))
        stream = zlib.compress(b"BT /F1 %d Tf %d TL %d %d Td\n%s\nET" % (SIZE, LEADING, LEFT, TOP, shown))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


# workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pdf(pages: Column, title: Column) -> Column:
    """Bytes of a PDF of an array of page texts; nulls count as empty, no pages as one empty page."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([pdf_bytes([t or "" for t in x.as_py() or []] or [""], n.as_py() or "") for x, n in zip(texts, names)], pa.binary())

    return made(pages, title)


def dossier(hits: DataFrame, pages: DataFrame, title: str, most: int = 50, first: int = 3) -> DataFrame:
    """content: one PDF with a cover, a table of contents and the first pages of each document of hits (file_id, name, rank), best first.

    A dossier is a file that somebody reads: at most `most` documents, that limit being the feature."""
    best = hits.groupBy("file_id").agg(F.min("rank").alias("rank"), F.min("name").alias("name")).orderBy("rank", "file_id").limit(most)
    some = pages.where(F.col("page") <= first).join(F.broadcast(best), "file_id")
    each = some.groupBy("file_id", "rank", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]).alias("texts"))
    all_of = each.agg(F.array_sort(F.collect_list(F.struct("rank", "file_id", "name", "texts"))).alias("d"))
    cover = F.concat(F.lit(title + "\n"), F.size("d").cast("string"), F.lit(" documents"))
    contents = F.array_join(F.transform("d", lambda x: F.coalesce(x["name"], x["file_id"])), "\n")
    body = F.flatten(F.transform("d", lambda x: x["texts"]))
    return all_of.select(pdf(F.concat(F.array(cover, contents), body), F.lit(title)).alias("content"))
