"""Sources: HTML chrome, DOCX controls, PDF pages, folders, URLs, the entry of all of them; pages as chunks."""

from __future__ import annotations

import http.server
import io
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import model as M
from foliospark.operators import segment as S
from foliospark.sources import bibliography as B
from foliospark.sources import fetch as U
from foliospark.sources import files as D
from foliospark.sources import ingest as I
from foliospark.streaming import ledger as L

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_page_chrome_is_no_text():
    page = "<html><head><title>t</title><body><nav><p>menu</p></nav>before<select><option>x</option></select> after<footer>foot <p>more</p></footer><p>end</p>"
    assert [b[0] for b in D.html_blocks_of(page)] == ["before after", "end"]


def test_docx_controls_boxes_and_inner_tables():
    inner = f"<w:tbl><w:tr><w:tc>{p('i1')}</w:tc><w:tc>{p('i2')}</w:tc></w:tr></w:tbl>"
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    box = f"<w:p><w:r><w:t>anchor</w:t><mc:AlternateContent><mc:Choice><w:txbxContent>{p('in the box')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('in the box')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    body = p("one") + f"<w:sdt><w:sdtContent>{p('two')}<w:sdt><w:sdtContent>{p('three')}</w:sdtContent></w:sdt></w:sdtContent></w:sdt>"
    body += f"<w:tbl><w:tr>{cell(p('a') + inner)}<w:sdt><w:sdtContent>{cell(p('b'))}</w:sdtContent></w:sdt></w:tr></w:tbl>" + box
    assert [(b[0], b[3]) for b in D.extract_docx(docx(body), {})] == [("one", "body"), ("two", "body"), ("three", "body"), ("a | b", "table"), ("i1 | i2", "table"), ("anchor", "body"), ("in the box", "body")]


def test_columns_are_read_one_after_the_other():
    left, right = [f"left line {k} goes on" for k in range(8)], [f"right line {k} ends" for k in range(8)]
    page = ["A heading that runs across both of the columns of it", *[f"{a:<28}{b}" for a, b in zip(left, right, strict=True)]]
    assert D.column_order(page) == [page[0], *left, *right]
    plain = [f"one long line of prose number {k} that fills the whole width of the page" for k in range(9)]
    assert D.column_order(plain) == plain


def test_pdf_pages_without_text_are_told(spark):
    pages = ["Text of the first page, long enough to count as read by anyone.", "", "  \n", "Last page of the file, with text that is long enough to be read."]
    got = D.pdf_blocks(pages, {4: ["Results"]}, lambda n: "seen by eye" if n == 2 else "")
    assert [(b[0][:11], *b[1:]) for b in got] == [("Text of the", 1, None, "body"), ("seen by eye", 2, None, "ocr"), ("", 3, None, "unread"), ("Results", 4, "Results", "heading"), ("Last page o", 4, "Results", "body")]
    D.EXTRACTORS["fakepdf"] = (lambda raw, options: D.pdf_blocks(raw.decode().split("\f")), None)
    files = spark.createDataFrame([("a.fakepdf", b"\f".join(x.encode() for x in pages)), ("b.fakepdf", b" \f "), ("c.txt", b"some words here"), ("d.docx", b"no zip"), ("e.txt", b"")], "path string, content binary")
    files = files.withColumn("length", F.length("content").cast("bigint"))
    rows = {r.file: (r.status, r.pages, r.unread_pages, r.tokens > 0) for r in D.inventory_tokens(files).collect()}
    # session workers have no extractor that only this process registered
    assert rows["c.txt"] == ("ready", None, 0, True) and rows["d.docx"][0] == "unreadable" and rows["e.txt"][0] == "empty"
    del D.EXTRACTORS["fakepdf"]
    floor = D.reading_floor(D.inventory_tokens(files.filter("path = 'c.txt'")), 2.0, 10.0).first()
    assert floor.files == 1 and floor.usd == pytest.approx(floor.tokens * 2e-6 + 500 * 1e-5)


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "B.MD").write_text("# Head\n\nBody of the Markdown file, in upper-case ending.")
    (tmp_path / "in" / "a.txt").write_text("First paragraph of the text.\n\nSecond paragraph of the text.")
    (tmp_path / "in" / "skip.xyz").write_text("not claimed")
    (tmp_path / "in" / "deep" / "c.html").write_text("<p>A page that lies deeper in the tree.</p>")
    (tmp_path / "in" / "few.txt").write_text("few")
    return tmp_path / "in"


def test_folders(spark, tree):
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.select("path").collect())
    assert names(D.read_files(spark, str(tree))) == ["B.MD", "a.txt", "c.html", "few.txt"]
    assert names(D.read_files(spark, str(tree), recursive=False)) == ["B.MD", "a.txt", "few.txt"]


def test_ingest(spark, tree):
    sources = [str(tree), "Inline text that stands for a document\n\nin two paragraphs.", "missing.pdf", "tiny", "http://127.0.0.1/x.html"]
    assert [I.kind_of(spark, s) for s in sources] == ["folder", "inline", "missing", "inline", "url"]
    rows = I.ingest(spark, sources).collect()
    read = {r.document.rsplit("/", 1)[-1]: 0 for r in rows if r.error is None}
    assert set(read) == {"B.MD", "a.txt", "c.html", "inline-1"}
    lost = {r.document.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in rows if r.error is not None}
    assert lost == {"few.txt": "empty document", "missing.pdf": "FileNotFoundError", "inline-2": "empty document", "x.html": "Refused"}
    assert [(r.block_id, r["text"]) for r in sorted((r for r in rows if r.document == "inline-1"), key=lambda r: r.block_id)] == [(1, "Inline text that stands for a document"), (2, "in two paragraphs.")]


class Handler(http.server.BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):  # noqa: N802
        if self.path.startswith("/hop"):
            n = int(self.path[4:])
            self.send_response(302)
            self.send_header("Location", f"/hop{n - 1}" if n else "/page?x=1")
            self.end_headers()
            return
        body = b"z" * 5000 if self.path == "/large" else b"<p>found</p>"
        self.send_response(200 if self.path != "/gone" else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):  # noqa: N802
        type(self).tries += 1
        size = int(self.headers["Content-Length"])
        asked = self.rfile.read(size).decode()
        if type(self).tries < 3:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        seen = self.headers.get("X-Team", "")
        self.wfile.write(('{"choices": [{"message": {"content": "%s %s"}, "finish_reason": "stop"}]}' % (seen, "effort" if "reasoning_effort" in asked else "plain")).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def web():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch_follows_checked_redirects_only(web):
    seen = []

    def check(host, port):
        seen.append(host)
        return [host]

    assert U.fetch_url(f"{web}/hop3", check=check) == (b"<p>found</p>", "html") and len(seen) == 5
    for bad in (f"{web}/hop11", f"{web}/gone", f"{web}/large", "ftp://x.org/a"):
        with pytest.raises(OSError if bad.endswith("gone") else U.Refused):
            U.fetch_url(bad, most=4000, check=check)
    with pytest.raises(U.Refused):
        U.fetch_url(f"{web}/page")


@pytest.mark.parametrize("address", ["127.0.0.1", "10.1.2.3", "169.254.169.254", "192.168.0.1", "100.64.0.1", "::1", "fe80::1%eth0", "fc00::1", "::ffff:10.0.0.1", "0.0.0.0", "224.0.0.1"])
def test_addresses_inside_are_refused(address):
    with pytest.raises(U.Refused):
        U.public_addresses("name", 80, lambda *a, **k: [(0, 0, 0, "", ("93.184.216.34", 80)), (0, 0, 0, "", (address, 80))])
    assert U.public_addresses("name", 80, lambda *a, **k: [(0, 0, 0, "", ("93.184.216.34", 80))]) == ["93.184.216.34"]


def test_fetched_pages_are_extracted(spark, web):
    urls = spark.createDataFrame([(f"{web}/page",), (f"{web}/page",), (None,), (f"{web}/gone",)], "url string")
    rows = U.fetch(urls, check=lambda host, port: [host]).collect()
    assert len(rows) == 2 and {r.error is None for r in rows} == {True, False}
    blocks = D.extract(spark.createDataFrame([(r.path, r.content) for r in rows if r.error is None], "path string, content binary")).collect()
    assert [r["text"] for r in blocks] == ["found"]


def test_http_client_retries_and_sends_headers_and_effort(web, monkeypatch):
    monkeypatch.setenv("TEST_KEY", "k")
    monkeypatch.setattr(M.time, "sleep", lambda s: None)
    send = M.http_client(web, "TEST_KEY", "m", headers={"X-Team": "blue"}, effort="low").make()
    assert send("hello", {}) == ("blue effort", "stop") and Handler.tries == 3
    with pytest.raises(ValueError):
        M.http_client(web, "TEST_KEY", "m", effort="most")
    with pytest.raises(ValueError):
        M.http_client(web, "TEST_KEY", "m", headers={"X": "a\nb"})
    monkeypatch.delenv("TEST_KEY")
    with pytest.raises(KeyError):
        M.http_client(web, "TEST_KEY", "m").make()


def test_pages_as_chunks(spark):
    data = [("a", 1, "one", None), ("a", 2, "two", 1), ("a", 3, "three", None), ("a", 4, "four", None), ("a", 5, "five", 2), ("a", 6, "six", 1), ("a", 7, "seven", None), ("b", 1, "w " * 50, None), ("b", 2, "x", None), ("c", 1, "y " * 70, 3), ("c", 2, "z", 4)]
    blocks = spark.createDataFrame(data, "document string, block_id int, text string, page int")
    got = S.segment(blocks, S.SegmentSpec("page", 32)).orderBy("document", "chunk_id").collect()
    assert [(r.text, r.page) for r in got if r.document == "a"] == [("one", None), ("two\n\nsix", 1), ("three\n\nfour", None), ("seven", None), ("five", 2)]
    assert [r.tokens for r in got if r.document == "b"] == [32, 19] and {r.page for r in got if r.document == "b"} == {None}
    assert [(r.tokens, r.page, r.block_id) for r in got if r.document == "c"] == [(32, 3, 1), (32, 3, 1), (6, 3, 1), (1, 4, 2)]


def test_exports_in_a_folder(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - A title\nAU  - Doe, J\nPY  - 2001\nER  - \n")
    (tmp_path / "b.bib").write_text("@article{k, title = {Other}, author = {Roe, R}, year = 2002}")
    rows = B.read_exports(spark, str(tmp_path)).collect()
    assert sorted(r.title for r in rows) == ["A title", "Other"]


def test_documents_stream_into_the_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        arriving = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
        query = L.stream_documents(arriving, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        assert query.exception() is None
        docs.union(spark.createDataFrame([(4, "c")], docs.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
