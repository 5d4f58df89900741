"""PPTX: slides in order, with titles, lists, tables and pictures."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from .docx import number_text

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Kinds of automatic numbers and what stands around them.
AUTO = {"arabic": "decimal", "alphaLc": "lowerLetter", "alphaUc": "upperLetter", "romanLc": "lowerRoman", "romanUc": "upperRoman"}
AROUND = {"ParenBoth": "({})", "ParenR": "{})", "Period": "{}.", "Plain": "{}"}


class Slides:
    """Lines (text, tag_type, level_1, level_2, can_be_multiline, annotations), tables as
    lists of (row, column, text, colspan, rowspan, invisible); slides are pages."""

    def __init__(self, content: bytes) -> None:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        self.lines, self.tables = [], []
        for name in names:
            rels = f"ppt/slides/_rels/{name.rsplit('/', 1)[1]}.rels"
            images = {x.get("Id"): x.get("Target", "").rsplit("/", 1)[-1] for x in ElementTree.fromstring(z.read(rels))} if rels in z.namelist() else {}
            first = True
            tree = ElementTree.fromstring(z.read(name)).find(f".//{P}spTree")
            for shape in tree.iter() if tree is not None else ():
                if shape.tag == P + "sp":
                    kind = shape.find(f".//{P}nvPr/{P}ph")
                    title = first or kind is not None and kind.get("type", "").lower() in ("title", "ctrtitle")
                    first = not self.shape(shape, title) and first
                elif shape.tag == A + "tbl":
                    self.link("table", f"table_{len(self.tables)}")
                    self.tables.append(self.table(shape))
                elif shape.tag == P + "pic":
                    blip = shape.find(f".//{A}blip")
                    if blip is not None and blip.get(R + "embed") in images:
                        self.link("attachment", images[blip.get(R + "embed")])

    def link(self, name: str, value: str) -> None:
        if not self.lines:
            self.lines.append(("", None, None, None, True, []))
        self.lines[-1][5].append({"start": 0, "end": len(self.lines[-1][0]), "name": name, "value": value})

    def shape(self, shape, title: bool) -> bool:
        counts: dict[tuple[int, str], int] = {}
        some = False
        for p in shape.iter(A + "p"):
            props = p.find(A + "pPr")
            level = int(props.get("lvl", "0")) if props is not None else 0
            text, notes = "", []
            for run in p:
                if run.tag == A + "br":
                    text += "\n"
                if run.tag not in (A + "r", A + "fld"):
                    continue
                start = len(text)
                text += "".join(t.text or "" for t in run.iter(A + "t"))
                said = run.find(A + "rPr")
                if said is not None and len(text) > start:
                    flags = {"b": "bold", "i": "italic"}
                    values = {n: "True" for k, n in flags.items() if said.get(k) == "1"} | ({"underlined": "True"} if said.get("u", "none") != "none" else {}) | ({"size": f"{int(said.get('sz')) / 100:g}"} if said.get("sz") else {})
                    notes += [{"start": start, "end": len(text), "name": n, "value": v} for n, v in values.items()]
            if not text.strip():
                continue
            auto = props.find(A + "buAutoNum") if props is not None else None
            bullet = props.find(A + "buChar") if props is not None else None
            if title and not some:
                self.lines.append((text, "header", 1.0, 1.0, False, notes))
            elif auto is not None:
                kind = auto.get("type", "arabicPeriod")
                counts = {k: v for k, v in counts.items() if k[0] <= level}
                counts[level, kind] = counts.get((level, kind), int(auto.get("startAt", "1")) - 1) + 1
                number = number_text(next((v for k, v in AUTO.items() if kind.startswith(k)), "decimal"), counts[level, kind])
                lead = next((v for k, v in AROUND.items() if kind.endswith(k)), "{}.").format(number) + " "
                self.lines.append((lead + text, "list_item", 2.0, level + 1.0, False, [a | {"start": a["start"] + len(lead), "end": a["end"] + len(lead)} for a in notes]))
            elif bullet is not None:
                lead = bullet.get("char", "•") + " "
                self.lines.append((lead + text, "list_item", 3.0, level + 1.0, False, [a | {"start": a["start"] + len(lead), "end": a["end"] + len(lead)} for a in notes]))
            else:
                self.lines.append((text, None, None, None, True, notes))
            some = True
        return some

    def table(self, t) -> list[tuple]:
        out = []
        for r, row in enumerate(t.findall(A + "tr")):
            for c, cell in enumerate(row.findall(A + "tc")):
                text = "\n".join("".join(x.text or "" for x in p.iter(A + "t")) for p in cell.iter(A + "p"))
                hidden = cell.get("hMerge") == "1" or cell.get("vMerge") == "1"
                out.append((r, c, text, int(cell.get("gridSpan", "1")), int(cell.get("rowSpan", "1")), hidden))
        return out
