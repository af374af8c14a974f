"""Queries over PDF files, which are made of the documents in four shapes: plain streams and a table of
references; filter chains and an update; object streams and a stream of references; a damaged table."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import pdf
from ..sources.tables import BLOCKS_SQL, LINES_PER_PAGE, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = "WITH " + BLOCKS_SQL + sql
        return f

    return add


def _string(text: str) -> bytes:
    data = text.encode("latin-1", "replace")
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r")):
        data = data.replace(a, b)
    return b"(" + data + b")"


def make_pdf(text: str, shape: int, title: str) -> bytes:
    """A file whose pages show 20 lines of a text each and are turned by quarters."""
    lines = text.split("\n")
    pages = [lines[i : i + LINES_PER_PAGE] for i in range(0, len(lines), LINES_PER_PAGE)]
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    extra, layer = 4 + 2 * len(pages), 5 + 2 * len(pages)
    catalog = f"<</Type/Catalog/Pages 2 0 R/OCProperties<</OCGs[{layer} 0 R]/D<</OFF[{layer} 0 R]>>>>/Names<</EmbeddedFiles<</Names[(note)<</Type/Filespec/F(note.txt)/EF<</F {extra} 0 R>>>>]>>>>".encode()
    catalog += b"/AcroForm<</Fields[<</T(person)/FT/Tx/Kids[<</T(name)/V" + _string(title) + b">><</T(age)/V(7)/Ff 2>>]>><</T(ok)/FT/Btn/V/Yes/Kids[<<>><<>>]>>]>>"
    catalog += b"/OpenAction<</S/JavaScript/JS(1)>>>>" if len(lines) % 5 == 0 else b">>"
    font = b"/Resources<</Font<</F1<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Serif>>/F2<</Type/Font/Subtype/TrueType/BaseFont/Sans>>>>>>"
    heads = {1: catalog, layer: b"<</Type/OCG/Name(notes)>>", 2: f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}/MediaBox[0 0 612 792]".encode() + font + b">>", 3: b"<</Title" + _string("old" if shape == 1 else title) + b"/Author<FEFF00C90065>>>"}
    bodies = {}
    for k, page in enumerate(pages):
        link = b"/Annots[<</Type/Annot/Subtype/Link/Rect[1 2 3.5 4]/A<</S/URI/URI(http://example.com/%d)>>>>]" % len(lines) if k == 0 else b""
        heads[4 + 2 * k] = f"<</Type/Page/Parent 2 0 R/Rotate {90 * (k % 4)}/Contents {5 + 2 * k} 0 R".encode() + link + b">>"
        shown = b"BT /F1 10 Tf 12 TL 72 720 Td\n" + b"\n".join(_string(t) + b" Tj T*" for t in page) + b"\nET"
        if shape == 1:
            bodies[5 + 2 * k] = (b"/Filter[/ASCII85Decode/FlateDecode]", base64.a85encode(zlib.compress(shown)) + b"~>")
        elif shape == 2:
            bodies[5 + 2 * k] = (b"/Filter/FlateDecode", zlib.compress(shown))
        else:
            bodies[5 + 2 * k] = (b"", shown)
    bodies[extra] = (b"/Type/EmbeddedFile", title.encode())
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(num: int, body: bytes) -> None:
        places[num] = len(out)
        out.extend(b"%d 0 obj\n%b\nendobj\n" % (num, body))

    stream = lambda head, data: b"<<%b/Length %d>>stream\n%b\nendstream" % (head, len(data), data)
    for num, (head, data) in bodies.items():
        put(num, stream(head, data))
    size = 6 + 2 * len(pages)
    if shape == 2:
        inside, index = b"", []
        for num, body in heads.items():
            index.append(b"%d %d" % (num, len(inside)))
            inside += body + b" "
        first = b" ".join(index) + b" "
        put(size, stream(b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(heads), len(first)), zlib.compress(first + inside)))
        rows, at = b"", len(out)
        order = {num: i for i, num in enumerate(heads)}
        for num in range(size + 2):
            where = places | {size + 1: at}
            kind, a, b = (2, size, order[num]) if num in order else (1, where[num], 0) if num in where else (0, 0, 65535)
            rows += bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        put(size + 1, stream(b"/Type/XRef/Size %d/W[1 4 2]/Root 1 0 R/Info 3 0 R/Filter/FlateDecode" % (size + 2), zlib.compress(rows)))
        return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at
    for num, body in heads.items():
        put(num, body)
    at = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % places[num] for num in range(1, size)))
    out.extend(b"trailer\n<</Size %d/Root 1 0 R/Info 3 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (size, at + 7 * (shape == 3)))
    if shape == 1:
        put(3, b"<</Title" + _string(title) + b"/Author<FEFF00C90065>>>")
        new = len(out)
        out.extend(b"xref\n3 1\n%010d 00000 n \ntrailer\n<</Size %d/Root 1 0 R/Info 3 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (places[3], size, at, new))
    return bytes(out)


def document_files(spark, sf_dir):
    """(path, content): each document as a file."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                files = [make_pdf(t or "", k % 4, f"Document ({k})") for k, t in rows]
                yield pa.record_batch([pa.array([str(k) for k, _ in rows]), pa.array(files, pa.binary())], ["path", "content"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(made, "path string, content binary")


@query(r""", p AS (SELECT doc_id, page, count(*) AS n, string_agg(regexp_replace(text, '[^\x{0000}-\x{00FF}]', '?', 'g'), chr(10) ORDER BY idx) AS t FROM b GROUP BY ALL)
SELECT doc_id, CAST(page AS BIGINT) AS page, 612.0::DOUBLE AS width, CAST(90 * ((page - 1) % 4) AS BIGINT) AS rotation, 2 * n + 5 AS operations, md5(t) AS text FROM p""")
def pdf_pages(spark, sf_dir):
    """Pages with their inherited box, rotation, operations and text."""
    p = pdf.pages(document_files(spark, sf_dir))
    return p.select(F.col("path").cast("long").alias("doc_id"), "page", "width", "rotation", "operations", F.md5("text").alias("text"))


@query(""", p AS (SELECT doc_id, CAST(max(page) AS BIGINT) AS pages FROM b GROUP BY doc_id)
SELECT doc_id, '1.5' AS version, pages, 'Document (' || doc_id || ')' AS title, 'Ée' AS author, CAST(CASE doc_id % 4 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS revisions, CAST(CASE doc_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 1 END AS BIGINT) AS sections, doc_id % 4 = 3 AS repaired FROM p""")
def pdf_metadata(spark, sf_dir):
    m = pdf.metadata(document_files(spark, sf_dir))
    return m.select(F.col("path").cast("long").alias("doc_id"), "version", "pages", "title", "author", "revisions", "sections", "repaired")


@query(""", p AS (SELECT doc_id, max(page) AS pages FROM b GROUP BY doc_id)
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 1 THEN 6 + 2 * pages WHEN 2 THEN pages + 3 ELSE 5 + 2 * pages END AS BIGINT) AS objects, CAST(CASE doc_id % 4 WHEN 2 THEN pages + 3 ELSE pages + 1 END AS BIGINT) AS streams, CAST(CASE doc_id % 4 WHEN 1 THEN pages WHEN 2 THEN pages + 2 ELSE 0 END AS BIGINT) AS packed FROM p""")
def pdf_objects(spark, sf_dir):
    """Objects by a scan of each file."""
    o = pdf.objects(document_files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("objects"), F.count_if(F.col("kind") == "stream").alias("streams"), F.count_if(F.array_contains("filters", "FlateDecode")).alias("packed"))
    return o.select(F.col("path").cast("long").alias("doc_id"), "objects", "streams", "packed")


@query(""", ln AS (SELECT doc_id, count(*) % 5 = 0 AS js FROM b GROUP BY doc_id)
SELECT doc_id, CASE WHEN js THEN 4 ELSE 0 END::BIGINT AS javascript, 1::BIGINT AS uri, 3::BIGINT AS embedded_file, CASE WHEN js THEN 2 ELSE 0 END::BIGINT AS open_action, CASE WHEN js THEN 10 ELSE 4 END::BIGINT AS total FROM ln""")
def pdf_risks(spark, sf_dir):
    r = pdf.risks(document_files(spark, sf_dir))
    return r.select(F.col("path").cast("long").alias("doc_id"), "javascript", "uri", "embedded_file", "open_action", "total")


@query(""", ln AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) SELECT doc_id, 1::BIGINT AS page, 'Link' AS subtype, 3.5::DOUBLE AS right_edge, 'http://example.com/' || n AS uri FROM ln""")
def pdf_annotations(spark, sf_dir):
    a = pdf.annotations(document_files(spark, sf_dir))
    return a.select(F.col("path").cast("long").alias("doc_id"), "page", "subtype", F.col("box")[2].alias("right_edge"), "uri")


@query(""" SELECT doc_id, unnest(['person.name', 'person.age', 'ok']) AS name, unnest(['text', 'text', 'button']) AS type, unnest(['Document (' || doc_id || ')', '7', 'Yes']) AS value, unnest([0, 2, 0])::BIGINT AS flags, unnest([1, 1, 2])::BIGINT AS widgets FROM documents""")
def pdf_form_fields(spark, sf_dir):
    return pdf.form_fields(document_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "name", "type", "value", "flags", "widgets")


@query(""" SELECT doc_id, 'name_tree' AS source, 'note.txt' AS name, length('Document (' || doc_id || ')') AS size, sha256('Document (' || doc_id || ')') AS sha256 FROM documents""")
def pdf_attachments(spark, sf_dir):
    return pdf.attachments(document_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "source", "name", "size", "sha256")


@query(""" SELECT doc_id, unnest(['ABCDEF+Serif', 'Sans']) AS name, unnest(['Type1', 'TrueType']) AS subtype, unnest([true, false]) AS subset FROM documents""")
def pdf_fonts(spark, sf_dir):
    return pdf.fonts(document_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "name", "subtype", "subset")


@query(""" SELECT doc_id, 'notes' AS name, false AS shown FROM documents""")
def pdf_layers(spark, sf_dir):
    return pdf.layers(document_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "name", "shown")
