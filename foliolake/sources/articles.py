"""Articles in TEI XML: title, authors, abstract, sections, tables, figures, references."""

from __future__ import annotations

from xml.etree import ElementTree

T = "{http://www.tei-c.org/ns/1.0}"
ID = "{http://www.w3.org/XML/1998/namespace}id"


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def article_items(name: str, content: bytes) -> list[tuple]:
    """Lines (text, tag_type, level_1, level_2, can_be_multiline, annotations). References
    in the text are annotations whose value is the id of what they point at."""
    root = ElementTree.fromstring(content)
    out: list[tuple] = [(_text(root.find(f".//{T}titleStmt/{T}title")), "root", 0.0, 0.0, True, [])]
    put = lambda text, kind, a, b, notes=(): out.append((text, kind, float(a), float(b), False, list(notes)))
    for author in root.findall(f".//{T}sourceDesc//{T}analytic/{T}author"):
        put("", "author", 1, 1)
        for tag, kind in (("persName/{T}forename", "author_first_name"), ("persName/{T}surname", "author_surname"), ("email", "email")):
            for x in author.findall(T + tag.replace("{T}", T)):
                put(_text(x), kind, 2, 1)
        for place in author.findall(T + "affiliation"):
            put("", "author_affiliation", 2, 1)
            for x in place.findall(T + "orgName"):
                put(_text(x), "org_name", 3, 1)
            if place.find(T + "address") is not None:
                put(_text(place.find(T + "address")), "address", 3, 1)
    words = root.findall(f".//{T}profileDesc//{T}keywords/{T}term")
    if words:
        put("", "keywords", 1, 1)
        for x in words:
            put(_text(x), "keyword", 2, 1)
    abstract = root.find(f".//{T}profileDesc/{T}abstract")
    if abstract is not None:
        put("Abstract", "abstract", 1, 1)
        put(_text(abstract), "raw_text", 2, 1)
    known = {x.get(ID): "table" if x.get("type") == "table" else "attachment" for x in root.iter(T + "figure") if x.get(ID)} | {x.get(ID): "reference" for x in root.iter(T + "biblStruct") if x.get(ID)}
    for div in root.findall(f".//{T}body/{T}div"):
        head = div.find(T + "head")
        if head is not None:
            number = head.get("n", "")
            put(f"{number} {_text(head)}".strip(), "section", 1, max(1, len([x for x in number.split(".") if x])))
        for p in div.findall(T + "p"):
            text, notes = "", []
            for node, value in ((None, p.text), *((y, v) for x in p for y, v in ((x, _text(x)), (None, x.tail)))):
                start = len(text)
                text += value or ""
                target = (node.get("target") or "").lstrip("#") if node is not None else ""
                if target in known and len(text) > start:
                    notes.append({"start": start, "end": len(text), "name": known[target], "value": target})
            out.append((text, "raw_text", None, None, True, notes))
    for fig in root.iter(T + "figure"):
        if fig.get("type") != "table":
            put(_text(fig.find(T + "figDesc")) or _text(fig.find(T + "head")), "figure", 1, 1, [{"start": 0, "end": 0, "name": "attachment", "value": fig.get(ID) or ""}])
    entries = list(root.iterfind(f".//{T}listBibl/{T}biblStruct"))
    if entries:
        put("bibliography", "bibliography", 1, 1)
        for x in entries:
            put("", "bibliography_item", 2, 1, [{"start": 0, "end": 0, "name": "bibliography_uid", "value": x.get(ID) or ""}])
            for path, kind in ((f".//{T}title[@level='a']", "title"), (f".//{T}title[@level='j']", "title_journal"), (f".//{T}imprint/{T}date", "date")):
                if x.find(path) is not None:
                    put(_text(x.find(path)) or x.find(path).get("when", ""), kind, 3, 1)
    return out


def article_tables(content: bytes) -> list[list[tuple]]:
    out = []
    for fig in ElementTree.fromstring(content).iter(T + "figure"):
        if fig.get("type") == "table":
            rows = fig.findall(f"{T}table/{T}row")
            out.append([(r, c, _text(x), int(x.get("cols", "1")), int(x.get("rows", "1")), False) for r, row in enumerate(rows) for c, x in enumerate(row.findall(T + "cell"))])
    return out
