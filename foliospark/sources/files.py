"""Document sources: files of text, Markdown, HTML and DOCX to blocks(document, block_id, text, page, section, kind)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "document string, block_id int, text string, page int, section string, kind string"
Block = tuple[str, int | None, str | None, str]
#: extension -> (function(bytes, options) -> blocks, name of a package it needs or None)
EXTRACTORS: dict[str, tuple[Callable[[bytes, dict], list[Block]], str | None]] = {}
#: Unpacked bytes beyond which a DOCX is refused.
MAX_UNPACKED = 512 << 20


def register_extractor(*extensions: str, needs: str | None = None):
    """Add an extractor for extensions; the latest registration wins."""

    def add(run):
        for e in extensions:
            EXTRACTORS[e] = (run, needs)
        return run

    return add


def available(needs: str | None) -> bool:
    import importlib.util

    return needs is None or importlib.util.find_spec(needs) is not None


# ---------------------------------------------------------------- text
#: Byte order marks, longest first.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def decode(raw: bytes, charset: str | None = None) -> str:
    """By mark, then the declared charset, then zeros in every other byte, then UTF-8; bytes that are not UTF-8 as Windows-1252."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    if charset:
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    head = raw[:4096]
    if len(head) >= 4:
        odd, even = head[1::2].count(0) / max(1, len(head[1::2])), head[0::2].count(0) / max(1, len(head[0::2]))
        if odd > 0.4 and even < 0.1:
            return raw.decode("utf-16-le", "replace")
        if even > 0.4 and odd < 0.1:
            return raw.decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


@register_extractor("txt", "text", "csv", "tsv", "log")
def extract_text(raw: bytes, options: dict) -> list[Block]:
    text = re.sub(r"\r\n?", "\n", decode(raw, options.get("charset")))
    return [(p.rstrip(), None, None, "body") for p in re.split(r"\n(?:[ \t 　]*\n)+", text) if p.strip()]


@register_extractor("md", "markdown", "rmd", "qmd")
def extract_markdown(raw: bytes, options: dict) -> list[Block]:
    """Headings set the section; fenced code and pipe tables are blocks of their own."""
    out: list[Block] = []
    section, fence, held, kind = None, None, [], "body"

    def flush() -> None:
        nonlocal held, kind
        if "".join(held).strip():
            out.append(("\n".join(held).strip("\n"), None, section, kind))
        held, kind = [], "body"

    for line in re.sub(r"\r\n?", "\n", decode(raw, options.get("charset"))).split("\n"):
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                kind, fence = "code", None
                flush()
            else:
                held.append(line)
            continue
        if mark and not (mark[1][0] == "`" and "`" in mark[2]):
            flush()
            fence = mark[1]
            continue
        heading = re.match(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", line)
        if heading:
            flush()
            section = heading[1]
            if section:
                out.append((section, None, section, "heading"))
        elif not line.strip():
            flush()
        elif re.match(r"^\s*\|.*\|\s*$", line):
            if kind != "table":
                flush()
                kind = "table"
            held.append(line)
        else:
            if kind == "table":
                flush()
            held.append(line)
    if fence:
        kind = "code"
    flush()
    return out


# ---------------------------------------------------------------- HTML
#: Tags that break a block, tags whose content is no text.
BLOCK_TAGS = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form header hr html li main nav ol p section summary ul".split())
SILENT_TAGS = set("script style noscript template head title svg nav footer select".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.section: str | None = None
        self.held: list[str] = []
        self.kind = "body"
        self.silent = 0
        self.pre = 0
        self.rows: list[list[str]] = []

    def flush(self) -> None:
        text = "".join(self.held)
        text = text.strip("\n") if self.kind == "code" else re.sub(r"[ \t\r\n\f]+", " ", text).strip()
        self.held = []
        if not text.strip():
            return
        if self.rows:
            self.rows[-1].append(text)
        elif self.kind == "heading":
            self.section = text
            self.blocks.append((text, None, text, "heading"))
        else:
            self.blocks.append((text, None, self.section, self.kind))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT_TAGS:
            if tag in BLOCK_TAGS:
                self.flush()
            self.silent += 1
        elif tag == "body":
            self.flush()
            self.silent = 0  # a head that was never closed
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind = "heading"
        elif tag == "pre":
            self.flush()
            self.kind, self.pre = "code", self.pre + 1
        elif tag == "tr":
            self.flush()
            self.rows.append([])
        elif tag in ("td", "th") or (tag in BLOCK_TAGS and not self.pre) or tag in ("table", "caption"):
            self.flush()

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag) or tag == "pre":
            self.flush()
            self.kind, self.pre = "body", max(0, self.pre - (tag == "pre"))
        elif tag == "tr":
            self.flush()
            cells = self.rows.pop() if self.rows else []
            if cells:
                line = " | ".join(cells)
                if self.rows:
                    self.rows[-1].append(line)
                else:
                    self.blocks.append((line, None, self.section, "table" if len(cells) > 1 else "body"))
        elif tag in ("td", "th", "table", "caption") or (tag in BLOCK_TAGS and not self.pre):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def html_charset(raw: bytes) -> str | None:
    m = re.search(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", raw[:4096], re.I)
    return m[1].decode("ascii") if m else None


@register_extractor("html", "htm", "xhtml")
def extract_html(raw: bytes, options: dict) -> list[Block]:
    return html_blocks_of(decode(raw, options.get("charset") or html_charset(raw)))


def html_blocks_of(text: str) -> list[Block]:
    page = _Page()
    page.feed(text)
    page.close()
    page.flush()
    return page.blocks


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of a table of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(d, k, *b) for d, h in zip(pdf.document, pdf.html, strict=True) for k, b in enumerate(html_blocks_of(h or ""), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"page": "Int32"})

    return pages.select(F.col(key).cast("string").alias("document"), F.col(html).alias("html")).mapInPandas(run, BLOCKS)


# ---------------------------------------------------------------- DOCX
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_headings(styles: bytes | None) -> set[str]:
    """Style ids that are headings themselves or through basedOn."""
    if not styles:
        return set()
    names, parent = {}, {}
    for s in ElementTree.fromstring(styles).iter(f"{_W}style"):
        key = s.get(f"{_W}styleId", "")
        name = s.find(f"{_W}name")
        base = s.find(f"{_W}basedOn")
        names[key] = (name.get(f"{_W}val", "") if name is not None else "").lower()
        parent[key] = base.get(f"{_W}val") if base is not None else None
    found = {k for k, n in names.items() if re.match(r"heading ?\d|title$", n)}
    for _ in range(10):
        more = {k for k, p in parent.items() if p in found} - found
        if not more:
            break
        found |= more
    return found


_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
#: Containers that a paragraph's text does not go through: boxes are paragraphs of their own, fallbacks repeat them.
_BOX = f"{_W}txbxContent"
_WRAPPERS = {f"{_W}{t}" for t in ("sdt", "sdtContent", "customXml", "smartTag", "ins", "moveTo")}


def _docx_text(p) -> str:
    out: list[str] = []

    def walk(x) -> None:
        for c in x:
            if c.tag in (_BOX, _FALLBACK):
                continue
            if c.tag in (f"{_W}t", f"{_M}t"):
                out.append(c.text or "")
            elif c.tag == f"{_W}tab":
                out.append("\t")
            elif c.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            else:
                walk(c)

    walk(p)
    return "".join(out)


def _docx_parts(x) -> Iterator:
    """Paragraphs and tables in order, through content controls and the like."""
    for c in x:
        if c.tag in (f"{_W}p", f"{_W}tbl"):
            yield c
        elif c.tag in _WRAPPERS:
            yield from _docx_parts(c)


def _docx_children(x, tag: str) -> Iterator:
    """Rows of a table or cells of a row, through content controls; not those of a table inside."""
    for c in x:
        if c.tag == tag:
            yield c
        elif c.tag in _WRAPPERS:
            yield from _docx_children(c, tag)


def _docx_boxes(p) -> Iterator:
    """Text boxes anchored in a paragraph, without the fallbacks that repeat them."""
    for c in p:
        if c.tag == _BOX:
            yield c
        elif c.tag != _FALLBACK:
            yield from _docx_boxes(c)


@register_extractor("docx")
def extract_docx(raw: bytes, options: dict) -> list[Block]:
    """Paragraphs, headings by style, tables row by row, text boxes after their paragraph, foot- and endnotes in the
    order they are cited. A table inside a cell gives its own rows, after the row that holds it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
            raise ValueError("the file unpacks to too much")
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        headings = _docx_headings(z.read("word/styles.xml") if "word/styles.xml" in names else None)
        notes = {}
        for kind in ("footnote", "endnote"):
            if f"word/{kind}s.xml" in names:
                for n in ElementTree.fromstring(z.read(f"word/{kind}s.xml")).iter(f"{_W}{kind}"):
                    notes[kind, n.get(f"{_W}id")] = "\n".join(filter(None, (_docx_text(p).strip() for p in n.iter(f"{_W}p"))))
    out: list[Block] = []
    section: str | None = None

    def add(x) -> None:
        nonlocal section
        if x.tag == f"{_W}tbl":
            for row in _docx_children(x, f"{_W}tr"):
                cells, inner = [], []
                for cell in _docx_children(row, f"{_W}tc"):
                    parts = list(_docx_parts(cell))
                    cells.append(" ".join(filter(None, (_docx_text(p).strip() for p in parts if p.tag == f"{_W}p"))))
                    inner += [p for p in parts if p.tag == f"{_W}tbl"]
                if any(cells):
                    out.append((" | ".join(cells), None, section, "table"))
                for table in inner:
                    add(table)
            return
        style = x.find(f"{_W}pPr/{_W}pStyle")
        text = _docx_text(x).strip()
        if text and style is not None and style.get(f"{_W}val") in headings:
            section = text
            out.append((text, None, section, "heading"))
        elif text:
            out.append((text, None, section, "body"))
        for box in _docx_boxes(x):
            for part in _docx_parts(box):
                add(part)

    for part in _docx_parts(body) if body is not None else []:
        add(part)
    for kind in ("footnote", "endnote"):
        for ref in (body if body is not None else ElementTree.Element("x")).iter(f"{_W}{kind}Reference"):
            if text := notes.get((kind, ref.get(f"{_W}id"))):
                out.append((text, None, section, "footnote"))
    return out


#: Visible characters under which a page counts as scanned.
OCR_MIN_CHARS = 40
#: A page has two columns if this share of its lines is blank at the gutter, and this share has text on both sides.
GUTTER, GUTTER_BLANK, BOTH_SIDES = 3, 0.8, 0.4


def column_order(lines: list[str]) -> list[str]:
    """Lines of a page in reading order: where a gutter parts two columns, the left one of each band and then the right
    one; a line across the gutter ends a band. Lines keep the places of their characters, as layout extraction gives them."""
    filled = [line for line in lines if line.strip()]
    width = max(map(len, filled), default=0)
    if len(filled) < 6 or width < 24:
        return lines
    best = None
    for x in range(width * 3 // 10, width * 7 // 10):
        blank = sum(not line[x : x + GUTTER].strip() for line in filled)
        both = sum(bool(line[:x].strip()) and bool(line[x + GUTTER :].strip()) and not line[x : x + GUTTER].strip() for line in filled)
        if blank >= GUTTER_BLANK * len(filled) and both >= BOTH_SIDES * len(filled) and (best is None or (both, blank) > best[0]):
            best = (both, blank), x
    if best is None:
        return lines
    x, out, right = best[1], [], []
    for line in lines:
        if line[x : x + GUTTER].strip():
            out += [*right, line]
            right = []
        else:
            out.append(line[:x].rstrip())
            if line[x:].strip():
                right.append(line[x:].strip())
    return [line for line in [*out, *right] if line.strip()]


def pdf_blocks(pages: list[str], titles: dict[int, list[str]] | None = None, ocr: Callable[[int], str] | None = None, least: int = OCR_MIN_CHARS) -> list[Block]:
    """Blocks of the texts of pages: running lines dropped, columns put in order, outline titles as headings of the page
    (from 1) they point to. A page with fewer than ``least`` visible characters is read by ``ocr``; what stays without
    text is a block of kind ``unread``, so no page goes missing silently."""
    out: list[Block] = []
    section = None
    for n, page in enumerate(drop_running_lines(pages), 1):
        for title in (titles or {}).get(n, []):
            section = title
            out.append((title, n, section, "heading"))
        text, kind = "\n".join(column_order(page.split("\n"))).strip(), "body"
        if len(re.sub(r"\s", "", text)) < least and ocr is not None:
            seen = ocr(n).strip()
            text, kind = (seen, "ocr") if len(seen) > len(text) else (text, kind)
        out.append((text, n, section, kind) if text else ("", n, section, "unread"))
    return out


def _outline_titles(reader) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}

    def walk(items) -> None:
        for x in items:
            if isinstance(x, list):
                walk(x)
            elif getattr(x, "title", None):
                out.setdefault(reader.get_destination_page_number(x) + 1, []).append(x.title.strip())

    walk(reader.outline)
    return out


def _page_reader(raw: bytes) -> Callable[[int], str] | None:
    """Text of a page by OCR, where the packages for it are there."""
    if not (available("pytesseract") and available("pdf2image")):
        return None
    import pytesseract
    from pdf2image import convert_from_bytes

    return lambda n: pytesseract.image_to_string(convert_from_bytes(raw, first_page=n, last_page=n)[0])


@register_extractor("pdf", needs="pypdf")
def extract_pdf(raw: bytes, options: dict) -> list[Block]:
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(raw))
    pages = [p.extract_text(extraction_mode="layout") or "" for p in reader.pages]
    return pdf_blocks(pages, _outline_titles(reader), _page_reader(raw), options.get("ocr_min_chars", OCR_MIN_CHARS))


@register_extractor("png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", needs="pytesseract")
def extract_image(raw: bytes, options: dict) -> list[Block]:
    import pytesseract
    from PIL import Image

    text = pytesseract.image_to_string(Image.open(io.BytesIO(raw)))
    return [(text.strip(), 1, None, "ocr")] if text.strip() else []


def drop_running_lines(pages: list[str], least: int = 3, depth: int = 2) -> list[str]:
    """Pages without lines that stand, numbers aside, among the first or last ``depth`` of at least ``least`` pages and
    of half of them."""
    key = lambda line: re.sub(r"\d+", "#", re.sub(r"\s+", " ", line.strip().lower()))
    split = [p.split("\n") for p in pages]
    edges: dict[str, int] = {}
    for lines in split:
        own = [line for line in lines if line.strip()]
        for k in {key(line) for line in own[:depth] + own[-depth:]}:
            edges[k] = edges.get(k, 0) + 1
    running = {k for k, n in edges.items() if k and n >= max(least, len(pages) / 2)}
    out = []
    for lines in split:
        spots = [i for i, line in enumerate(lines) if line.strip()]
        near = set(spots[:depth] + spots[-depth:])
        out.append("\n".join(line for i, line in enumerate(lines) if not (i in near and key(line) in running)))
    return out


# ---------------------------------------------------------------- scans
def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, content of every file an extractor claims, whatever the case of its ending."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    glob = "*.{" + ",".join(either(e) for e in sorted(EXTRACTORS)) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)


def extract(files: DataFrame, options: dict | None = None) -> DataFrame:
    """blocks of files(path, content), with ``error`` where a file could not be read; a bad file fails no task."""
    options = options or {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*[c.split()[0] for c in BLOCKS.split(", ")], "error"]
        for pdf in parts:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                try:
                    run_one, needs = EXTRACTORS[ext]
                    if not available(needs):
                        raise RuntimeError(f"needs the package {needs}")
                    found = run_one(bytes(content), options)
                    blocks = [b for b in found if b[0].strip()]
                    rows += [(path, k, *b, None) for k, b in enumerate(blocks, 1)]
                    rows += [(path, 0, None, page, None, kind, f"no text on page {page}") for text, page, _, kind in found if kind == "unread"]
                    if not found:
                        rows.append((path, 0, None, None, None, None, "no text"))
                except Exception as e:  # the contract: errors are values of the row
                    rows.append((path, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=columns).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, BLOCKS + ", error string")


def inventory(files: DataFrame) -> DataFrame:
    """One row a file from files(path, length): folder, file, ext, bytes, extractor status."""
    ext = extension_of(F.col("path"))
    known = F.create_map(*[x for e, (_, needs) in sorted(EXTRACTORS.items()) for x in (F.lit(e), F.lit("ready" if available(needs) else "needs_package"))])
    status = F.when(F.col("length") == 0, "empty").otherwise(F.coalesce(known[ext], F.lit("no_extractor")))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), ext.alias("ext"), F.col("length").alias("bytes"), status.alias("status"),
    )


def inventory_tokens(files: DataFrame, options: dict | None = None) -> DataFrame:
    """The inventory of files(path, length, content) with pages, unread pages, tokens (heuristic) and what is wrong.

    A file all of whose pages lack text is ``needs_ocr``, one that cannot be read ``unreadable``.
    """
    from foliospark.functions.tokens import count_tokens

    blocks = extract(files, options)
    sums = blocks.groupBy("document").agg(
        F.max("page").alias("pages"), F.sum((F.col("kind") == "unread").cast("int")).alias("unread_pages"), F.sum(count_tokens(F.col("text"))).alias("tokens"), F.first("error", ignorenulls=True).alias("note"),
        F.sum(F.col("text").isNotNull().cast("int")).alias("_blocks"),
    )
    rows = inventory(files.select("path", "length")).withColumn("document", F.concat_ws("/", F.when(F.col("folder") != F.col("file"), F.col("folder")), "file"))
    joined = rows.join(sums, "document", "left")
    failed = (F.col("status") == "ready") & (F.col("_blocks") == 0)
    status = F.when(failed & (F.col("unread_pages") > 0), "needs_ocr").when(failed & (F.col("note") != "no text"), "unreadable").when(failed, "empty").otherwise(F.col("status"))
    return joined.select("file", "folder", "ext", "bytes", status.alias("status"), "pages", F.coalesce("unread_pages", F.lit(0)).alias("unread_pages"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "note")


def reading_floor(rows: DataFrame, input_usd: float, output_usd: float, reply_tokens: int = 500) -> DataFrame:
    """One row: files that can be read, their tokens, and the least they cost, one call a file."""
    ready = F.col("status") == "ready"
    sums = rows.agg(F.coalesce(F.sum(ready.cast("int")), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(ready, F.col("tokens"))), F.lit(0)).alias("tokens"))
    return sums.withColumn("usd", F.col("tokens") / 1e6 * input_usd + F.col("files") * reply_tokens / 1e6 * output_usd)


def by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
