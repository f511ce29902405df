"""Documents, feeds, robots, records, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import documents, feeds, records, robots


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, value in members.items():
            z.writestr(name.replace("__", "/"), value)
    return out.getvalue()


def pack(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, value in members.items():
            z.writestr(name, value)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = pack({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = pack({"xl/workbook.xml": '<workbook><sheets><sheet name="S" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>year</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'})
PPTX = pack({"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": "<s xmlns:a='a'><a:p><a:t>two</a:t></a:p></s>", "ppt/slides/slide1.xml": "<s xmlns:a='a'><a:p><a:t>one</a:t></a:p></s>"})
ODT = pack({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<d xmlns:t='t'><t:h>Head</t:h><t:p>Para</t:p></d>"})
ODS = pack({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": "<d xmlns:t='t'><t:table t:name='N'><t:table-row><t:table-cell>1</t:table-cell><t:table-cell>2</t:table-cell></t:table-row></t:table></d>"})
EPUB = pack({"mimetype": "application/epub+zip", "c1.xhtml": "<html><body><p>Chapter one.</p></body></html>"})
RTF = b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Hello\\par caf\\'e9 \\u" + b"8364?\\{x\\}}"


@pytest.mark.parametrize(
    ("data", "url", "claimed", "kind", "text"),
    [
        (DOCX, "", "", "docx", "Hello\na | b/c"), (XLSX, "", "", "xlsx", "## S\nyear | 5\nx"), (PPTX, "", "", "pptx", "## Slide 1\none\n\n## Slide 2\ntwo"),
        (ODT, "", "", "odt", "Head\nPara"), (ODS, "", "", "ods", "## N\n1 | 2"), (EPUB, "", "", "epub", "Chapter one."), (RTF, "", "", "rtf", "Hello\ncafé €{x}"),
        (b"country;year\nDK;2024\n", "x.csv", "", "csv", "country | year\nDK | 2024"), (b"<html>", "x.csv", "", "", ""), (b"a,b", "x.html", "", "", ""),
        (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x", "f.doc", "", "doc", ""), (b"PK\x03\x04broken", "f.xlsx", "", "", ""), (b"%PDF-1.4", "", "", "pdf", ""), (b"", "", "", "", ""), (None, "", "", "", ""),
    ],
)
def test_documents(data, url, claimed, kind, text):
    assert documents.kind_of(data, url, claimed) == kind
    got, reason = documents.to_text(data, kind)
    assert got == text and bool(reason) == (not text)


def test_read(spark):
    rows = spark.createDataFrame([("a.docx", bytearray(DOCX)), ("b.bin", bytearray(b"??")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in documents.read(rows).collect()}
    assert got["a.docx"].kind == "docx" and got["b.bin"].reason == "not_a_document" and got["c"].text == ""


def test_feeds(spark):
    rss = "<rss><item><title>One &amp; two - The Post</title><link>http://www.bing.com/news/apiclick?url=https%3a%2f%2fx.org%2f1</link><description><![CDATA[<b>bold</b> text]]></description><pubDate>Mon, 29 Jan 2024 12:00:00 GMT</pubDate></item><item><title></title><link>http://y.org</link></item><item><title>own</title><link>https://www.bing.com/a</link></item></rss>"
    rows = feeds.news(spark.createDataFrame([(1, rss)], "query_id int, body string")).collect()
    assert [(r.url, r.snippet, r.source) for r in rows] == [("https://x.org/1", "bold  text", "x.org")]
    heads = feeds.headlines(spark.createDataFrame([(1, rss)], "query_id int, body string")).collect()
    assert (heads[0].title, heads[0].publisher) == ("One & two", "The Post")
    body = '{"results":[{"title":"t","url":"https://a.org"},{"title":"u","url":""}],"unresponsive_engines":[["brave","timeout"]]}'
    answers = spark.createDataFrame([(1, body), (2, "{bad")], "query_id int, body string")
    assert [r.url for r in feeds.metasearch(answers).collect()] == ["https://a.org"]
    assert [(r.engine, r.reason) for r in feeds.unresponsive(answers).collect()] == [("brave", "timeout")]
    swept = feeds.sweep_queries(spark.createDataFrame([(1, "q")], "query_id int, query string"), ["a.org", "b.org"]).collect()
    assert {r.query for r in swept} == {"site:a.org q", "site:b.org q"}
    own = spark.createDataFrame([("a.org", "https://x.a.org/1"), ("a.org", "https://nota.org/1")], "domain string, url string")
    assert feeds.on_domain(own).count() == 1


def test_robots(spark):
    rules = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private")], "domain string, body string")
    asked = spark.createDataFrame([("https://a.org/private/1",), ("https://a.org/x",), ("https://b.org/private",), ("bad",)], "url string")
    assert {r.url: r.allowed for r in robots.allowed(asked, rules).collect()} == {"https://a.org/private/1": False, "https://a.org/x": True, "https://b.org/private": True, "bad": False}


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"domain":"a","ok":1.0}\n{broken\n')
    assert [r.domain for r in records.read(spark, str(tmp_path / "r.json"), records.DOMAIN).collect()] == ["a"]
    records.write(spark.createDataFrame([("a", 1.0)], "domain string, ok double"), str(tmp_path / "out"))
    assert records.read(spark, str(tmp_path / "out"), records.DOMAIN).count() == 1


def test_streams(spark, tmp_path):
    from millrace.streaming import index

    src, store = str(tmp_path / "in"), str(tmp_path / "corpus")
    rows = [("https://a.org", "T", "ok", "word " * 300), ("https://b.org", "T", "failed", "")]
    spark.createDataFrame(rows, "url string, title string, quality string, content string").write.parquet(src)
    for k in range(2):  # the second run finds every passage stored
        stream = spark.readStream.schema("url string, title string, quality string, content string").parquet(src)
        sink = index.indexer(store)
        q = stream.writeStream.foreachBatch(lambda df, epoch, k=k: sink(df, epoch + k)).option("checkpointLocation", str(tmp_path / f"ck{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("id").distinct().count() > 0
    log = str(tmp_path / "log")
    spark.createDataFrame([("t", float(k), k, k != 3) for k in range(6)], "tier string, at double, seq long, refused boolean").coalesce(1).write.parquet(log)
    for made, column, want in ((lambda s: index.budget(s.drop("refused"), 2, 3.0), "granted", [True, True, False, True, True, False]), (index.cooldown, "strikes", [1, 2, 3, 0, 1, 2])):
        name = f"out_{column}"
        stream = spark.readStream.schema("tier string, at double, seq long, refused boolean").parquet(log)
        q = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert [r[0] for r in spark.table(name).orderBy("seq").select(F.col(column)).collect()] == want


def test_scans():
    from millrace.sources import scans

    english, french = "the cat of the house and the dog in the yard was on it at that time", "le chat dans la rue est sur les toits des maisons pour une nuit avec toi"
    calls = []

    def recognise(image, language):
        calls.append(language)
        return {b"e": english, b"f": french if language == "fra" else french, b"a": "lub yl " * 20 if language == "eng" else "arabic text"}[image]

    assert scans.read([b"e"], ["eng"], recognise, lambda i: "Latin") == (english, "") and calls == ["eng"]
    assert scans.choose(b"f", ["eng", "fra"], recognise, lambda i: "Latin") == ("fra", "")
    assert scans.read([b"a"], ["eng", "ara"], recognise, lambda i: "Arabic") == ("arabic text", "")
    assert scans.read([], ["eng"], recognise, lambda i: "")[1] == "no_pages" and scans.read([b"e"], [], recognise, lambda i: "")[1] == "no_language_data"
    assert len(scans.read([b"e"] * 20, ["eng"], recognise, lambda i: "")[0].split("\n\n")) == scans.MOST_PAGES


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, value in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), value)
    return out.getvalue()


def test_empty_cells_keep_their_columns():
    assert documents.to_text(b"a,b,c\n1,,3\n,,5\n", "csv") == ("a | b | c\n1 | | 3\n5", "")
    sheet = "<worksheet><sheetData><row><c r='A1'><v>1</v></c><c r='D1'><v>4</v></c></row></sheetData></worksheet>"
    book = packed(xl__workbook_xml="<workbook><sheets><sheet name='S'/></sheets></workbook>", xl__worksheets__sheet1_xml=sheet)
    assert documents.to_text(book, "xlsx") == ("## S\n1 | | | 4", "")
    assert [documents._place(x) for x in ("A1", "Z9", "AA3", None)] == [0, 25, 26, 0]


def test_chapters_in_reading_order():
    page = lambda n: f"<html><body><p>chapter {n}</p></body></html>"
    opf = "<package><manifest>" + "".join(f"<item id='i{n}' href='c{n}.xhtml'/>" for n in (1, 2, 10)) + "</manifest><spine>" + "".join(f"<itemref idref='i{n}'/>" for n in (1, 2, 10)) + "</spine></package>"
    book = packed(O__p_opf=opf, **{f"O__c{n}_xhtml": page(n) for n in (10, 1, 2)})
    assert documents.to_text(book, "epub")[0].split() == ["chapter", "1", "chapter", "2", "chapter", "10"]


def test_an_article_is_kept_whole():
    from millrace.operators.extract import _density

    html = "<body><div><a href='x'>menu menu menu menu</a></div><article><div><p>first part of it</p></div><section><p>second part</p></section></article></body>"
    assert _density(html)[0].split() == "first part of it second part".split()


def test_bodies_are_opened_by_their_bytes(spark, monkeypatch):
    from millrace.plans import fetch

    page = b"<html><body><article>" + b"word " * 300 + b"</article></body></html>"
    assert fetch.opened(DOCX, "https://a.org/x", "text/html")[1:] == ("Hello\na | b/c", "", "docx")  # the signature decides
    assert fetch.opened(page, "https://a.org/x.xlsx", "application/vnd.ms-excel")[0].startswith("<html>")  # a document that is a page
    assert fetch.opened(b"\x00" * 2000, "https://a.org/x", "image/png")[2] == "content_type:image/png"
    assert fetch.opened(b"%PDF-1.4 broken", "https://a.org/x")[2:] != ("", "") and fetch.opened(b"", "", "") == ("", "", "", "")
    monkeypatch.setattr(fetch, "MOST_DOCUMENT", 10)
    assert fetch.opened(DOCX)[2:] == ("document_too_large", "docx")
    monkeypatch.undo()
    tier = fetch.direct(lambda u: (200, "", RTF) if "rtf" in u else (403, "", b"Just a moment") if "wall" in u else (404, "", b""))
    got = fetch.Ladder((("direct", tier),)).run("https://a.org/rtf")
    assert (got["ok"], got["extractor"], got["text"]) == (True, "rtf", "Hello\ncafé €{x}")  # short documents are whole answers
    assert fetch.Ladder((("direct", tier),)).run("wall")["reason"] == "direct:challenge_needs_a_human" and tier("x")[2] == "http_404"
    bodies = spark.createDataFrame([("https://a.org/1", bytearray(DOCX), ""), ("https://a.org/2", bytearray(page), "text/html"), ("https://a.org/3", bytearray(b"x"), "image/png")], "url string, content binary, content_type string")
    asked = spark.createDataFrame([(f"https://a.org/{k}",) for k in range(1, 5)], "url string")
    rows = {r.url[-1]: r for r in fetch.fetch(asked, bodies).collect()}
    assert rows["1"].content == "Hello\na | b/c" and rows["1"].tier == "pages/docx" and "wordprocessing" in rows["1"].content_type
    assert rows["2"].quality == "ok" and rows["2"].content_type == "text/html" and rows["3"].failure_reason == "content_type:image/png"
    assert rows["4"].failure_reason == "not_in_pages"
    assert {r.url[-1]: r.content for r in fetch.fetch(asked, bodies, form="html").collect()}["2"].startswith("<html>")
