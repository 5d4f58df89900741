"""Readers: files or text columns to lines, cells and attachments.

Formats that Spark can't split are read whole in Arrow batches, one file a row; a file
that can't be read becomes a row with an error, never a failed job."""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import hashlib
import io
import json
import re
import tarfile
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import articles, docx, pptx

LINES = "doc_id long, line_id long, text string, tag_type string, tag_level_1 double, tag_level_2 double, annotations array<struct<start:long,end:long,name:string,value:string>>"
CELLS = "path string, table_id long, row_id long, col_id long, text string, colspan long, rowspan long, invisible boolean, error string"
ITEMS = "path string, line_id long, text string, tag_type string, tag_level_1 double, tag_level_2 double, can_be_multiline boolean, annotations array<struct<start:long,end:long,name:string,value:string>>, uid string, error string"
FILES = "path string, name string, content binary, error string"
PROPERTIES = "path string, key string, value string, error string"

#: What tags mean.
BLOCKS = {"aside", "article", "body", "div", "blockquote", "footer", "header", "html", "main", "nav", "section", "form", "p", "tr", "ul", "ol", "dl", "dir", "pre", "table"}
ITEM_TAGS, HEADERS, HIDDEN, VOID = {"li", "dd", "dt"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"script", "style", "head", "title", "template"}, {"br", "meta", "hr", "img", "input", "link", "wbr", "area", "col"}
STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "dfn": "italic", "var": "italic", "address": "italic", "u": "underlined", "ins": "underlined", "s": "strike", "del": "strike", "strike": "strike", "sup": "superscript", "sub": "subscript", "a": "linked_text"}


INLINE_STYLES = {"italic": re.compile(r"font-style\s*:\s*italic"), "bold": re.compile(r"font-weight\s*:\s*(bold|bolder|[6-9]00)")}


def css(style: str) -> list[tuple[str, str]]:
    """What an inline style says: names and values of annotations."""
    low = style.lower()
    out = [(name, "True") for name, p in INLINE_STYLES.items() if p.search(low)]
    if m := re.search(r"font-size\s*:\s*([\d.]+)(pt|px)", low):
        out.append(("size", f"{float(m[1]) / (0.75 if m[2] == 'px' else 1):g}"))
    if m := re.search(r"text-align\s*:\s*(left|right|center|justify|start|end)", low):
        out.append(("alignment", {"start": "left", "end": "left", "justify": "both"}.get(m[1], m[1])))
    if m := re.search(r"font-family\s*:\s*([^;]+)", style, re.I):
        out.append(("style", m[1].strip()))
    if re.search(r"display\s*:\s*(none|hidden)", low):
        out.append(("style", "hidden"))
    return out


def spread(rows: list[list[dict]]) -> list[tuple]:
    """(row, column, text, colspan, rowspan, invisible) of a table's cells in their places:
    what a span covers is taken by cells of one place that aren't shown."""
    grid: dict[tuple[int, int], tuple] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in grid:
                c += 1
            for dr in range(cell["rowspan"]):
                for dc in range(cell["colspan"]):
                    grid.setdefault((r + dr, c + dc), (cell["text"].strip(), *((cell["colspan"], cell["rowspan"], False) if not dr and not dc else (1, 1, True))))
            c += cell["colspan"]
    return [(*at, *grid[at]) for at in sorted(grid) if at[0] < len(rows)]


class Page(HTMLParser):
    """Lines and visible tables of a page as its tags open and close; what is left open ends
    with its block. A table is visible if it has a border or a cell with a solid one, or if
    all are asked for; the rows of others are lines, cells apart by tabs."""

    def __init__(self, every_table: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.tables: list[list[tuple]] = []
        self.every, self.within = every_table, []
        self.hidden = 0
        self.kind: tuple = (None, None, None)
        self.text = ""
        self.open: list[tuple[str, list, int]] = []  # tag, annotations, begin
        self.done: list[dict] = []
        self.numbers: list[int | None] = []
        self.types: list[str] = []

    def flush(self) -> None:
        for _, values, start in self.open:
            self.mark(values, start)
        self.open = [(tag, v, 0) for tag, v, _ in self.open if tag == "a" or tag in BLOCKS and tag != "p"]
        if self.text.strip():
            lead = len(self.text) - len(self.text.lstrip())
            body = self.text.strip()
            cut = lambda x: max(0, min(len(body), x - lead))
            spans = [a | {"start": cut(a["start"]), "end": cut(a["end"])} for a in self.done]
            self.lines.append((body, *self.kind, [a for a in spans if a["end"] > a["start"] and self.kind[0] != "header"]))
        self.text, self.done, self.kind = "", [], (None, None, None)

    def mark(self, values: list, start: int) -> None:
        if len(self.text) > start:
            self.done += [{"start": start, "end": len(self.text), "name": n, "value": v} for n, v in values]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        said = dict(attrs)
        if tag == "table":
            if not self.within:
                self.flush()
            self.within.append({"rows": [], "visible": self.every or (said.get("border") or "0") != "0"})
            return
        if self.within:
            self.in_table(tag, said)
            return
        style = css(said["style"]) if said.get("style") else []
        if tag in STYLES:
            style = [(STYLES[tag], said.get("href") or "" if tag == "a" else "True"), *style]
        if tag == "br":
            self.text += "\n"
        elif tag in HEADERS:
            self.flush()
            self.kind = ("header", 1.0, float(tag[1]))
        elif tag in ITEM_TAGS:
            self.flush()
            self.kind = ("list_item", 2.0, float(max(1, len(self.numbers))))
            if self.numbers and self.numbers[-1] is not None:
                self.numbers[-1] += 1
                kind, n = self.types[-1], self.numbers[-1]
                self.text = f"{docx.number_text('lowerLetter' if kind == 'a' else 'upperLetter', n)}) " if kind in ("a", "A") else f"{n}. "
        elif tag in BLOCKS:
            self.flush()
            if tag in ("ul", "dl", "dir", "ol"):
                self.numbers.append(0 if tag == "ol" else None)
                self.types.append(said.get("type") or "1")
        if style and tag not in VOID:
            self.open.append((tag, style, len(self.text)))

    def in_table(self, tag: str, said: dict) -> None:
        table = self.within[-1]
        if tag == "tr":
            table["rows"].append([])
        elif tag in ("td", "th"):
            if not table["rows"]:
                table["rows"].append([])
            number = lambda k: max(1, int(said.get(k))) if (said.get(k) or "").isdigit() else 1
            table["rows"][-1].append({"text": "", "colspan": number("colspan"), "rowspan": number("rowspan")})
            table["visible"] |= bool(re.search(r"border(-top|-bottom)[^;]*:[^;]*solid", (said.get("style") or "").lower()))
        elif tag in ("br", "p", "div", "li") and table["rows"] and table["rows"][-1] and table["rows"][-1][-1]["text"].strip():
            table["rows"][-1][-1]["text"] += "\n"

    def end_table(self) -> None:
        table = self.within.pop()
        if table["visible"]:
            self.tables.append(spread(table["rows"]))
            return
        rows = ["\t".join(c["text"].strip() for c in row) for row in table["rows"]]
        if self.within and self.within[-1]["rows"] and self.within[-1]["rows"][-1]:
            self.within[-1]["rows"][-1][-1]["text"] += "\n".join(rows)
        else:
            self.lines += [(x, None, None, None, []) for x in rows if x.strip()]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden or tag in VOID:
            return
        elif tag == "table":
            if self.within:
                self.end_table()
        elif self.within:
            return
        elif tag in BLOCKS | HEADERS | ITEM_TAGS:
            self.flush()
            self.open = self.open[: next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), len(self.open))]
            if tag in ("ul", "dl", "dir", "ol") and self.numbers:
                self.numbers.pop()
                self.types.pop()
        else:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
            if at is not None:
                self.mark(*self.open.pop(at)[1:])

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        data = re.sub(r"\s+", " ", data.replace("\xa0", " "))
        if not self.within:
            self.text += data
        elif self.within[-1]["rows"] and self.within[-1]["rows"][-1]:
            self.within[-1]["rows"][-1][-1]["text"] += data

    def finish(self) -> Page:
        self.close()
        while self.within:
            self.end_table()
        self.flush()
        return self


def read_page(html: str, every_table: bool = False) -> Page:
    page = Page(every_table)
    page.feed(html or "")
    return page.finish()


def parse_html(html: str) -> list[tuple]:
    return read_page(html).lines


def html_lines(rows: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Lines of pages: see LINES. A map over Arrow batches, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, i, *line) for d, html in zip(frame["doc_id"], frame["html"], strict=True) for i, line in enumerate(parse_html(html))]
            yield pd.DataFrame(out, columns=["doc_id", "line_id", "text", "tag_type", "tag_level_1", "tag_level_2", "annotations"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(run, LINES)


def decode(content: bytes, encoding: str | None = None) -> str:
    """Text in the named encoding, else in UTF-8 (with or without mark), else as detected,
    else in one byte a letter. Ends of lines are made line feeds."""
    return _decode(content, encoding).replace("\r\n", "\n").replace("\r", "\n")


def _decode(content: bytes, encoding: str | None) -> str:
    if encoding:
        return content.decode(encoding)
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(content).best()
        if best:
            return str(best)
    except ImportError:
        pass
    return content.decode("latin-1")


def csv_cells(name: str, content: bytes, delimiter: str | None = None, encoding: str | None = None) -> list[tuple]:
    sep = delimiter or ("\t" if name.lower().endswith(".tsv") else ",")
    return [(0, r, c, x) for r, row in enumerate(csv.reader(io.StringIO(decode(content, encoding)), delimiter=sep)) for c, x in enumerate(row)]


_NS = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main"}


def xlsx_cells(name: str, content: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = ["".join(t.itertext()) for t in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("s:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = sorted((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for k, sheet in enumerate(sheets):
        for r, row in enumerate(ElementTree.fromstring(z.read(sheet)).iterfind(".//s:row", _NS)):
            for cell in row.findall("s:c", _NS):
                column = 0
                for letter in re.match(r"[A-Z]+", cell.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                value = cell.find("s:v", _NS)
                text = "".join(cell.find("s:is", _NS).itertext()) if cell.find("s:is", _NS) is not None else "" if value is None else value.text or ""
                if cell.get("t") == "s":
                    text = shared[int(text)]
                elif cell.get("t") == "b":
                    text = str(text == "1")
                elif cell.get("t") in (None, "n") and text:
                    text = str(float(text))
                out.append((k, int(row.get("r", r + 1)) - 1, column - 1, text))
    return out


def docx_items(name: str, content: bytes) -> list[tuple]:
    return docx.Document(content).lines


def pptx_items(name: str, content: bytes) -> list[tuple]:
    return pptx.Slides(content).lines


def office_cells(tables: list[list[tuple]]) -> list[tuple]:
    return [(k, *cell) for k, t in enumerate(tables) for cell in t]


def html_cells(name: str, content: bytes) -> list[tuple]:
    return office_cells(read_page(decode(content)).tables)


def txt_items(name: str, content: bytes, encoding: str | None = None) -> list[tuple]:
    """Lines with their line feeds, composed letters, annotations of spacing (100 for each
    blank line before, 50 at least) and indentation (211 a blank, three a tab); a line that
    is set in by two blanks more than the one before (four a tab) begins a paragraph."""
    if name.lower().endswith(".gz"):
        content = gzip.decompress(content)
    out, blank, width = [], 0, 0
    text = decode(content, encoding)
    for line in text.split("\n")[: None if not text.endswith("\n") else -1]:
        if not line.strip():
            blank += 1
            continue
        line = unicodedata.normalize("NFC", line) + "\n"
        lead = re.match(r"[ \t]*", line)[0]
        now = len(lead.replace("\t", " " * 4))
        values = (("spacing", str(int(100 * max(0.5, blank)))), ("indentation", str(211 * len(lead.replace("\t", " " * 3)))))
        out.append((line, None, None, None, now - width < 2, [{"start": 0, "end": len(line), "name": n, "value": v} for n, v in values]))
        blank, width = 0, now
    return out


def note_items(name: str, content: bytes) -> list[tuple]:
    """A note is a JSON object with its text in `content`."""
    return [(str(json.loads(decode(content)).get("content", "")), None, None, None)]


def mhtml_parts(name: str, content: bytes) -> list[tuple[str, str, bytes]]:
    content = gzip.decompress(content) if name.lower().endswith(".gz") else content
    walk = email.message_from_bytes(content, policy=email.policy.default).walk()
    return [(p.get_content_type(), p.get_filename() or (p.get("Content-Location") or "part").rsplit("/", 1)[-1], p.get_payload(decode=True) or b"") for p in walk if not p.is_multipart()]


def mhtml_items(name: str, content: bytes) -> list[tuple]:
    """The lines of every part that is a page."""
    pages = [b for kind, _, b in mhtml_parts(name, content) if kind == "text/html" or re.match(rb"\s*(<!doctype html|<html)", b.lower())]
    return [(*x[:4], True, x[4]) for b in pages for x in parse_html(decode(b))]


def without_fields(data, paths: list[list[str]]) -> tuple[object, dict[str, str]]:
    """JSON without the values at some paths of keys, and these values; parents that are
    empty then go too."""
    taken: dict[str, str] = {}

    def cut(x, path: list[str], whole: list[str]):
        if not isinstance(x, dict) or path[0] not in x:
            return x
        if len(path) == 1:
            taken["_".join(whole)] = str(x[path[0]])
            rest = {k: v for k, v in x.items() if k != path[0]}
        else:
            inner = cut(x[path[0]], path[1:], whole)
            rest = {k: v for k, v in x.items() if k != path[0]} | ({path[0]: inner} if inner or inner == x[path[0]] else {})
        return rest

    for path in paths:
        data = cut(data, path, path)
    return data, taken


def json_items(name: str, content: bytes, html_fields: str = "") -> list[tuple]:
    """Keys in order, depth first: key, list_item and raw_text lines at their depth. Values
    at the paths in html_fields (a JSON list of lists of keys) are left to the attachments."""
    out: list[tuple] = []

    def walk(x, depth: int, kind: str) -> None:
        if isinstance(x, dict):
            for k in sorted(x):
                out.append((k, "key", float(depth), 1.0))
                walk(x[k], depth + 1, "raw_text")
        elif isinstance(x, list):
            for v in x:
                if isinstance(v, (dict, list)):
                    out.append(("", "list_item", float(depth), 1.0))
                    walk(v, depth + 1, "raw_text")
                else:
                    walk(v, depth, "list_item")
        elif x is not None:
            out.append((str(x), kind, float(depth), 1.0))

    walk(without_fields(json.loads(decode(content)), json.loads(html_fields) if html_fields else [])[0], 1, "raw_text")
    return out


def eml_items(name: str, content: bytes) -> list[tuple]:
    m = email.message_from_bytes(content, policy=email.policy.default)
    out = [(str(m["subject"] or ""), "root", 0.0, 0.0)]
    out += [(str(m[k]), k, 1.0, 0.0) for k in ("subject", "from", "to", "cc", "bcc", "date", "reply-to") if m[k]]
    body = m.get_body(("html", "plain"))
    if body is not None:
        text = body.get_content()
        out += [x[:4] for x in parse_html(text)] if body.get_content_type() == "text/html" else [(x, None, None, None) for x in text.replace("\r\n", "\n").split("\n")]
    return out


def html_items(name: str, content: bytes) -> list[tuple]:
    return [(*x[:4], True, x[4]) for x in parse_html(decode(content))]


def members(name: str, content: bytes, html_fields: str = "") -> list[tuple]:
    """Files in an archive, an office file, an e-mail (with its header as JSON) or a JSON
    file's HTML fields; empty ones are left out."""
    low = name.lower()
    if low.endswith(".json"):
        found = without_fields(json.loads(decode(content)), json.loads(html_fields) if html_fields else [])[1]
        return [(f"{k}.html", v.encode()) for k, v in found.items() if v]
    if low.endswith(".eml"):
        m = email.message_from_bytes(content, policy=email.policy.default)
        head = json.dumps({k: str(v) for k, v in m.items()}, ensure_ascii=False).encode()
        parts = [(safe_name(p.get_filename() or f"part_{i}"), b) for i, p in enumerate(m.iter_attachments()) if (b := p.get_payload(decode=True))]
        return [("message_header.json", head), *parts]
    if low.endswith((".mhtml", ".mht", ".mhtml.gz", ".mht.gz")):
        return [(n, b) for kind, n, b in mhtml_parts(name, content) if b and kind != "text/html"]
    data = io.BytesIO(content)
    if zipfile.is_zipfile(data):
        z = zipfile.ZipFile(data)
        office = low.endswith((".docx", ".xlsx", ".pptx"))
        return [(i.filename, z.read(i)) for i in z.infolist() if i.file_size and (not office or re.search(r"/(media|embeddings)/", i.filename))]
    data.seek(0)
    with tarfile.open(fileobj=data) as t:
        return [(i.name, t.extractfile(i).read()) for i in t.getmembers() if i.isfile() and i.size]


def safe_name(name: str) -> str:
    return re.sub(r"[^\w.() -]", "_", name.rsplit("/", 1)[-1])[-255:] or "file"


ITEM_READERS: dict[str, Callable[[str, bytes], list[tuple]]] = {
    ".tei.xml": articles.article_items, ".docx": docx_items, ".pptx": pptx_items, ".txt.gz": txt_items, ".txt": txt_items, ".md": txt_items, ".xml": txt_items, ".html": html_items, ".htm": html_items, ".shtml": html_items,
    ".note.json": note_items, ".json": json_items, ".eml": eml_items, ".mhtml.gz": mhtml_items, ".mht.gz": mhtml_items, ".mhtml": mhtml_items, ".mht": mhtml_items,
}
CELL_READERS: dict[str, Callable[[str, bytes], list[tuple]]] = {
    ".csv": csv_cells, ".tsv": csv_cells, ".xlsx": xlsx_cells, ".html": html_cells, ".htm": html_cells, ".docx": lambda n, c: office_cells(docx.Document(c).tables),
    ".pptx": lambda n, c: office_cells(pptx.Slides(c).tables), ".tei.xml": lambda n, c: office_cells(articles.article_tables(c)),
}
NESTED = (".zip", ".tar", ".tar.gz", ".tgz", ".eml", ".mhtml", ".mht", ".mhtml.gz", ".mht.gz", ".docx", ".xlsx", ".pptx")

#: Kinds of content by name endings; the first one that fits counts.
KINDS = (
    ("article", (".tei.xml",), ()), ("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)), ("excel", (".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    ("pptx", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)), ("txt", (".txt.gz", ".txt", ".md", ".xml"), ("text/plain",)), ("csv", (".csv", ".tsv"), ("text/csv", "text/tab-separated-values")),
    ("html", (".html", ".htm", ".shtml"), ("text/html",)), ("note", (".note.json",), ()), ("json", (".json",), ("application/json",)), ("archive", (".zip", ".tar", ".tar.gz", ".tgz", ".rar", ".7z"), ("application/zip", "application/x-tar")),
    ("pdf", (".pdf",), ("application/pdf",)), ("image", (".png", ".jpg", ".jpeg", ".tiff"), ("image/png", "image/jpeg", "image/tiff")), ("eml", (".eml",), ("message/rfc822",)), ("mhtml", (".mhtml.gz", ".mht.gz", ".mhtml", ".mht"), ("multipart/related",)),
)
#: These go by the name where it has an ending, all others by name or type.
BY_NAME = ("txt", "eml", "mhtml")
#: First bytes of kinds of content, in hexadecimal.
MAGIC = (("504B0304", "archive"), ("25504446", "pdf"), ("89504E47", "image"), ("FFD8FF", "image"), ("1F8B", "archive"))


def kind_of(path: Column, mime: Column) -> Column:
    """The reader of a file: by the ends of its name (two-part ones first) and by its type."""
    low = F.lower(path)
    named = F.regexp_extract(low, r"\.[^./]+$", 0) != ""
    case = None
    for kind, ends, mimes in KINDS:
        by_name = low.rlike("(" + "|".join(re.escape(e) for e in ends) + ")$")
        if kind == "json":
            by_name = by_name & ~low.endswith(".note.json")
        if kind == "txt":
            by_name = by_name & ~low.endswith(".tei.xml")
        by_type = mime.isin(*mimes) if mimes else F.lit(False)
        fits = by_name | (by_type & ~named if kind in BY_NAME else by_type)
        case = F.when(fits, kind) if case is None else case.when(fits, kind)
    return case


def kind_by_content(content: Column) -> Column:
    """What the first bytes say, for names that mislead."""
    head, case = F.hex(F.substring(content, 1, 4)), None
    for magic, kind in MAGIC:
        case = F.when(head.startswith(magic), kind) if case is None else case.when(head.startswith(magic), kind)
    return case.when(F.lower(F.substring(content, 1, 200).cast("string")).rlike(r"^\s*(<!doctype html|<html)"), "html")


def pdf_route(option: Column, first_page_good: Column, others_good: Column) -> Column:
    """Readers of a PDF's first page and of the others: as asked, or by the quality of the
    text layer; a bad first page alone is recognised alone."""
    text = F.when(option == "auto", "text_layer").otherwise("tabby")
    auto = option.isin("auto", "auto_tabby")
    one = lambda good: F.when(option == "true", "text_layer").when(option == "false", "image").when(option == "tabby", "tabby").when(auto & good, text).otherwise("image")
    return F.struct(one(first_page_good).alias("first"), one(others_good).alias("others"))


TABBY = "struct<pages:array<struct<number:int,blocks:array<struct<order:int,x_top_left:double,y_top_left:double,width:double,height:double,text:string,annotations:array<struct<start:int,end:int,is_bold:boolean,is_italic:boolean,font_size:int>>>>>>>"


def tabby_lines(files: DataFrame, json_col: str = "json") -> DataFrame:
    """path, page_id, line_id, text, bold, size: the extractor's JSON as lines, blocks in
    their order, cut at line feeds."""
    pages = files.select("path", F.explode(F.from_json(json_col, TABBY)["pages"]).alias("p"))
    blocks = pages.select("path", F.col("p.number").alias("page_id"), F.explode("p.blocks").alias("b"))
    rows = blocks.select("path", "page_id", "b.order", F.posexplode(F.split("b.text", "\n")).alias("part", "text"), F.exists("b.annotations", lambda a: a["is_bold"]).alias("bold"), F.get("b.annotations", F.lit(0))["font_size"].alias("size")).where("text <> ''")
    w = Window.partitionBy("path").orderBy("page_id", "order", "part")
    return rows.select("path", "page_id", (F.row_number().over(w) - 1).cast("long").alias("line_id"), "text", "bold", "size")


def _mapped(files: DataFrame, schema: str, width: int, choose: Callable[[str], Callable | None]) -> DataFrame:
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                reader = choose(path)
                try:
                    out += [(path, *row, None) for row in reader(path, bytes(content))]
                except Exception as e:  # a bad file is a row, not a failed job
                    out.append((path, *[None] * width, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=names)

    return files.where(F.col("path").rlike(r"\.\w+$")).select("path", "content").mapInPandas(run, schema)


def _reader(path: str, known: dict) -> Callable:
    """By the longest ending that is known."""
    low = path.lower()
    return known[max((e for e in known if low.endswith(e)), key=len)]


def _ending_in(known) -> Column:
    return F.lower("path").rlike("(" + "|".join(re.escape(x) for x in known) + ")$")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _options(read: Callable, given: dict) -> Callable:
    """A reader with those options that it takes."""
    takes = getattr(read, "__code__", None)
    mine = {k: v for k, v in given.items() if takes and v and k in takes.co_varnames[: takes.co_argcount]}
    return lambda n, c: read(n, c, **mine)


def read_items(files: DataFrame, **options: str | None) -> DataFrame:
    """Lines of text-like files by the ends of their names: see ITEMS. Options (encoding,
    html_fields) go to the readers that take them."""

    def numbered(path: str) -> Callable:
        read = _options(_reader(path, ITEM_READERS), options)

        def run(name: str, content: bytes) -> list[tuple]:
            key = hashlib.md5(content).hexdigest()
            return [(i, *row[:4], *(row[4:] if len(row) > 4 else (True,)), *([[]] if len(row) < 6 else []), f"{key}_{i}") for i, row in enumerate(read(name, content))]

        return run

    return _mapped(files.where(_ending_in(ITEM_READERS)), ITEMS, 8, numbered)


def read_cells(files: DataFrame, **options: str | None) -> DataFrame:
    """Cells of tables in files: see CELLS. Options are delimiter and encoding."""

    def filled(path: str) -> Callable:
        read = _options(_reader(path, CELL_READERS), options)
        return lambda n, c: [(*row, *((1, 1, False) if len(row) == 4 else ())) for row in read(n, c)]

    return _mapped(files.where(_ending_in(CELL_READERS)), CELLS, 7, filled)


def read_members(files: DataFrame, html_fields: str = "") -> DataFrame:
    """Attached files, one level down."""
    return _mapped(files, FILES, 2, lambda path: lambda n, c: members(n, c, html_fields))


def read_attachments(files: DataFrame, depth: int = 10, html_fields: str = "") -> DataFrame:
    """path, parent, depth, name, content, error: attached files level by level, `depth`
    levels down at most. A file that can't be opened is a row with its error and ends its
    branch. Each level is written to the checkpoint folder where one is set, so the levels
    before aren't opened again."""
    spark = files.sparkSession
    level, out = files.select("path", "content"), None
    opened = NESTED + ((".json",) if html_fields else ())
    for k in range(1, depth + 1):
        found = read_members(level.where(_ending_in(opened)), html_fields)
        found = found.select(F.concat("path", F.lit("!/"), F.coalesce("name", F.lit(""))).alias("path"), F.col("path").alias("parent"), F.lit(k).alias("depth"), "name", "content", "error")
        if spark.sparkContext.getCheckpointDir():
            found = found.checkpoint()
        if found.isEmpty():
            break
        out = found if out is None else out.unionByName(found)
        level = found.where("error IS NULL").select("path", "content")
    return out if out is not None else spark.createDataFrame([], "path string, parent string, depth int, name string, content binary, error string")


def file_metadata(files: DataFrame) -> DataFrame:
    """path, file_name, size, modified, kind of files as Spark lists them; contents aren't read."""
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"), kind_of(F.col("path"), F.lit(None).cast("string")).alias("kind"))


def read_properties(files: DataFrame) -> DataFrame:
    """Core properties of office files: see PROPERTIES."""
    return _mapped(files.where(_ending_in((".docx", ".xlsx", ".pptx"))), PROPERTIES, 2, lambda path: lambda n, c: sorted(docx.core_properties(c).items()))


def for_file(name: str) -> dict[str, Callable]:
    """Only the readers that a file name needs, for plans over one kind of file."""
    low = name.lower()
    found = {}
    for part, known in (("items", ITEM_READERS), ("cells", CELL_READERS)):
        ends = [e for e in known if low.endswith(e)]
        if ends:
            found[part] = known[max(ends, key=len)]
    if low.endswith(NESTED):
        found["members"] = members
    return found
