"""DOCX: paragraphs with styles, numbering, notes and tables.

A property is what the defaults say, then the chain of styles from the base on, then the
numbering's level, then the paragraph, then the run; the last one that says something wins."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Digits of Roman numbers.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
RUN_FLAGS = {"b": "bold", "i": "italic", "u": "underlined", "strike": "strike"}


def _val(node, name: str = "val", default=None):
    return default if node is None else node.get(W + name, default)


def number_text(kind: str, n: int) -> str:
    """The n-th number, counted from 1, in a list's format; unknown formats show nothing."""
    if kind == "decimal":
        return str(n)
    if kind in ("lowerRoman", "upperRoman"):
        out = ""
        for value, letters in ROMAN:
            out += letters * (n // value)
            n %= value
        return out.upper() if kind == "upperRoman" else out
    first, size = {"lowerLetter": ("a", 26), "upperLetter": ("A", 26), "russianLower": ("а", 32), "russianUpper": ("А", 32)}.get(kind, ("", 0))
    return chr(ord(first) + (n - 1) % size) * ((n - 1) // size + 1) if size else ""


class Numbering:
    """Counters of lists. A deeper level begins anew after a higher one; another list of the
    same kind goes on, unless it says that it starts over."""

    def __init__(self, root) -> None:
        self.levels, self.lists, self.counts, self.last, self.used = {}, {}, {}, {}, {}
        if root is None:
            return
        for abstract in root.iter(W + "abstractNum"):
            self.levels[_val(abstract, "abstractNumId")] = {int(_val(x, "ilvl", "0")): x for x in abstract.iter(W + "lvl")}
        for num in root.findall(W + "num"):
            over = {int(_val(x, "ilvl", "0")): int(_val(x.find(W + "startOverride"))) for x in num.findall(W + "lvlOverride") if x.find(W + "startOverride") is not None}
            self.lists[_val(num, "numId")] = (_val(num.find(W + "abstractNumId")), over)

    def level(self, num_id: str, ilvl: int):
        return self.levels.get(self.lists.get(num_id, (None, {}))[0], {}).get(ilvl)

    def _start(self, num_id: str, ilvl: int) -> int:
        over = self.lists[num_id][1]
        return over.get(ilvl, int(_val(self.level(num_id, ilvl).find(W + "start"), default="1")))

    def text(self, num_id: str, ilvl: int) -> str:
        level = self.level(num_id, ilvl)
        if level is None:
            return ""
        kind, over = self.lists[num_id]
        restart = ilvl in over and self.used.get(kind) not in (None, num_id) and (num_id, ilvl) not in self.counts
        before = self.last.get(kind)
        if restart or (kind, ilvl) not in self.counts or before is not None and before < ilvl:
            self.counts[kind, ilvl] = self._start(num_id, ilvl)
        else:
            self.counts[kind, ilvl] += 1
        self.counts[num_id, ilvl] = True
        self.last[kind], self.used[kind] = ilvl, num_id

        def shown(m: re.Match) -> str:
            at = int(m[1]) - 1
            other = self.level(num_id, at)
            if other is None:
                return ""
            n = self.counts.setdefault((kind, at), self._start(num_id, at))
            return number_text(_val(other.find(W + "numFmt"), default="decimal"), n)

        made = _val(level.find(W + "lvlText"), default="")
        if _val(level.find(W + "numFmt")) != "bullet":
            made = re.sub(r"%(\d)", shown, made)
        return made + {"space": " ", "nothing": ""}.get(_val(level.find(W + "suff"), default="tab"), "\t")


class Styles:
    def __init__(self, root) -> None:
        self.by_id, self.base, self.default = {}, [], None
        if root is None:
            return
        for d in root.iter(W + "docDefaults"):
            self.base += [x for x in (d.find(f"{W}pPrDefault/{W}pPr"), d.find(f"{W}rPrDefault/{W}rPr")) if x is not None]
        for s in root.iter(W + "style"):
            self.by_id[_val(s, "styleId")] = s
            if _val(s, "type") == "paragraph" and _val(s, "default") == "1":
                self.default = _val(s, "styleId")

    def chain(self, style: str | None) -> list:
        """Property elements of a style, the base first."""
        out, seen = [], set()
        while style in self.by_id and style not in seen:
            seen.add(style)
            s = self.by_id[style]
            out = [x for x in (s.find(W + "pPr"), s.find(W + "rPr")) if x is not None] + out
            style = _val(s.find(W + "basedOn"))
        return out

    def name(self, style: str | None) -> str:
        s = self.by_id.get(style)
        return _val(s.find(W + "name"), default=style or "") if s is not None else style or ""


def _flag(node) -> str:
    return "False" if _val(node, default="1") in ("0", "false", "none", "off") else "True"


def properties(elements: list) -> dict:
    """What a list of property elements says, later ones over earlier ones."""
    out: dict = {}
    for e in elements:
        for x in e:
            tag = x.tag.removeprefix(W)
            if tag in RUN_FLAGS:
                out[RUN_FLAGS[tag]] = _flag(x)
            elif tag == "sz":
                out["size"] = float(_val(x)) / 2
            elif tag == "vertAlign":
                out["vertical"] = _val(x)
            elif tag == "jc":
                out["alignment"] = {"start": "left", "end": "right", "both": "both"}.get(_val(x), _val(x))
            elif tag == "ind":
                left, first, hanging = (float(_val(x, n) or 0) for n in ("left", "firstLine", "hanging"))
                out["indentation"] = (float(_val(x, "start") or 0) or left) + (first or -hanging)
            elif tag == "spacing" and (_val(x, "before") or _val(x, "after")):
                out |= {k: int(_val(x, k)) for k in ("before", "after") if (_val(x, k) or "").isdigit()}
            elif tag == "outlineLvl":
                out["outline"] = int(_val(x))
            elif tag == "numPr":
                found = _val(x.find(W + "numId")), _val(x.find(W + "ilvl"))
                out["list"] = (found[0] or out.get("list", (None, None))[0], found[1] or out.get("list", (None, "0"))[1] or "0")
    return out


class Document:
    """Lines (text, tag_type, level_1, level_2, can_be_multiline, annotations) and tables."""

    def __init__(self, content: bytes) -> None:
        z = zipfile.ZipFile(io.BytesIO(content))
        part = lambda n: ElementTree.fromstring(z.read(n)) if n in z.namelist() else None
        self.styles, self.numbering = Styles(part("word/styles.xml")), Numbering(part("word/numbering.xml"))
        self.notes = {}
        for kind in ("footnote", "endnote"):
            root = part(f"word/{kind}s.xml")
            for note in root.iter(W + kind) if root is not None else ():
                self.notes[kind, _val(note, "id")] = "".join(t.text or "" for t in note.iter(W + "t")).strip()
        self.lines: list[tuple] = []
        self.tables: list[list[tuple]] = []
        self.after = 0
        for x in part("word/document.xml").find(W + "body"):
            if x.tag == W + "p":
                self.lines.append(self.paragraph(x))
            elif x.tag == W + "tbl":
                self.link(len(self.tables))
                self.tables.append(self.table(x))
            elif x.tag == W + "sdt":
                self.lines += [self.paragraph(p) for p in x.iter(W + "p")]

    def link(self, number: int) -> None:
        """A table belongs to the last paragraph with text, or to the one before that if it
        is the table's caption."""
        some = [i for i, line in enumerate(self.lines) if line[0].strip()]
        if some and len(some) > 1 and re.match(r"\s*(таблица|таб\.)", self.lines[some[-1]][0].lower()):
            some.pop()
        if some:
            text, *_, notes = self.lines[some[-1]]
            notes.append({"start": 0, "end": len(text), "name": "table", "value": f"table_{number}"})

    def paragraph(self, p) -> tuple:
        direct = p.find(W + "pPr")
        style = _val(direct.find(W + "pStyle")) if direct is not None and direct.find(W + "pStyle") is not None else self.styles.default
        chain = self.styles.base + self.styles.chain(style)
        seen = properties(chain + ([direct] if direct is not None else []))
        text, notes, level = "", [], None
        num, ilvl = seen.get("list", (None, "0"))
        if num and num != "0" and self.numbering.level(num, int(ilvl)) is not None:
            level = int(ilvl)
            text = self.numbering.text(num, level)
            of_level = self.numbering.level(num, level).find(W + "pPr")
            seen = properties(chain + ([of_level] if of_level is not None else []) + ([direct] if direct is not None else []))
        for run in p.iter(W + "r"):
            own = run.find(W + "rPr")
            named = _val(own.find(W + "rStyle")) if own is not None else None
            said = properties(chain + self.styles.chain(named) + ([own] if own is not None else []))
            start = len(text)
            for x in run:
                text += {W + "t": x.text or "", W + "tab": "\t", W + "br": "\n", W + "noBreakHyphen": "-"}.get(x.tag, "")
                kind = x.tag.removeprefix(W).removesuffix("Reference")
                if kind in ("footnote", "endnote") and (kind, _val(x, "id")) in self.notes:
                    notes.append({"start": 0, "end": -1, "name": "linked_text", "value": self.notes[kind, _val(x, "id")]})
            if len(text) > start:
                values = {n: "True" for n in RUN_FLAGS.values() if said.get(n) == "True"} | ({"size": f"{said['size']:g}"} if "size" in said else {}) | ({said["vertical"]: "True"} if said.get("vertical") in ("superscript", "subscript") else {})
                for name, value in values.items():
                    last = next((a for a in reversed(notes) if a["name"] == name), None)
                    if last and last["end"] == start and last["value"] == value:
                        last["end"] = len(text)
                    else:
                        notes.append({"start": start, "end": len(text), "name": name, "value": value})
        spacing = max(self.after, seen.get("before", 0))
        self.after = seen.get("after", 0)
        whole = {"style": self.styles.name(style), "spacing": str(spacing), "indentation": f"{seen.get('indentation', 0):g}", "alignment": seen.get("alignment", "left")}
        notes = [a | {"end": len(text)} if a["end"] < 0 else a for a in notes] + [{"start": 0, "end": len(text), "name": k, "value": v} for k, v in whole.items() if v and text]
        heading = re.match(r"(?i)\s*(?:heading|заголовок)\s*(\d+)", whole["style"])
        if re.match(r"(?i)\s*title\b", whole["style"]):
            return text, "header", 1.0, 1.0, False, notes
        if heading or "outline" in seen and seen["outline"] < 9 and level is None:
            return text, "header", 1.0, float(heading[1]) + 1 if heading else seen["outline"] + 2.0, False, notes
        if level is not None:
            return text, "list_item", 2.0, level + 1.0, False, notes
        return text, None, None, None, True, notes

    def table(self, t) -> list[tuple]:
        """(row, column, text, colspan, rowspan, invisible): cells that a span covers are
        copies that aren't shown. Tables in cells are left out."""
        grid: dict[tuple[int, int], list] = {}
        open_: dict[int, tuple[int, int]] = {}
        for r, row in enumerate(t.findall(W + "tr")):
            c = 0
            for cell in row.findall(W + "tc"):
                props = cell.find(W + "tcPr")
                span = int(_val(props.find(W + "gridSpan"), default="1")) if props is not None and props.find(W + "gridSpan") is not None else 1
                merge = props.find(W + "vMerge") if props is not None else None
                text = "\n".join("".join(x.text or "" for x in p.iter(W + "t")) for p in cell.findall(W + "p"))
                if merge is not None and _val(merge, default="continue") == "continue" and c in open_:
                    home = open_[c]
                    grid[home][2] += c == home[1]
                    for k in range(span):
                        grid[r, c + k] = [grid[home][0], 1, 1, True]
                else:
                    grid[r, c] = [text, span, 1, False]
                    open_.pop(c, None)
                    if merge is not None:
                        open_[c] = (r, c)
                    for k in range(1, span):
                        grid[r, c + k] = [text, 1, 1, True]
                c += span
        return [(r, c, *v) for (r, c), v in sorted(grid.items())]


def core_properties(content: bytes) -> dict[str, str]:
    """Title, author, dates and the like from a package's core properties."""
    z = zipfile.ZipFile(io.BytesIO(content))
    if "docProps/core.xml" not in z.namelist():
        return {}
    return {x.tag.rsplit("}", 1)[-1]: x.text or "" for x in ElementTree.fromstring(z.read("docProps/core.xml"))}
