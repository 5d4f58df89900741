"""Parameters of a run: strings as users give them, checked and typed."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .operators.layout import page_range
from .operators.patterns import DEFAULT, Pattern, parse_patterns

#: What the parameters may be.
CHOICES = {
    "document_type": ("", "other", "law", "tz", "diploma", "article", "fintoc"), "structure_type": ("tree", "linear"), "return_format": ("json", "html", "plain_text", "tree", "collapsed_tree", "ujson", "pretty_json"),
    "pdf_with_text_layer": ("auto_tabby", "true", "false", "auto", "tabby"), "is_one_column_document": ("auto", "true", "false"), "document_orientation": ("auto", "no_change"),
}
FLAGS = ("with_attachments", "need_content_analysis", "return_base64", "need_pdf_table_analysis", "fast_textual_layer_detection", "need_header_footer_analysis", "need_binarization", "need_gost_frame_analysis", "handle_invisible_table")


@dataclass(frozen=True)
class Options:
    document_type: str = ""
    patterns: str = ""
    structure_type: str = "tree"
    return_format: str = "json"
    with_attachments: str = "false"
    need_content_analysis: str = "false"
    recursion_deep_attachments: str = "10"
    return_base64: str = "false"
    need_pdf_table_analysis: str = "true"
    table_type: str = ""
    pdf_with_text_layer: str = "auto_tabby"
    fast_textual_layer_detection: str = "false"
    language: str = "rus+eng"
    pages: str = ":"
    is_one_column_document: str = "auto"
    document_orientation: str = "auto"
    need_header_footer_analysis: str = "false"
    need_binarization: str = "false"
    need_gost_frame_analysis: str = "false"
    delimiter: str | None = None
    encoding: str | None = None
    html_fields: str = ""
    handle_invisible_table: str = "false"

    @classmethod
    def of(cls, given: dict) -> Options:
        """Known names of a dictionary, checked; others are dropped."""
        known = {f.name for f in fields(cls)}
        made = cls(**{k: v if v is None else str(v) for k, v in given.items() if k in known})
        for name, allowed in CHOICES.items():
            if getattr(made, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}, not {getattr(made, name)!r}")
        for name in FLAGS:
            made.flag(name)
        int(made.recursion_deep_attachments)
        page_range(made.pages)
        return made

    def flag(self, name: str) -> bool:
        value = str(getattr(self, name)).lower()
        if value not in ("true", "false"):
            raise ValueError(f"{name} is true or false, not {value!r}")
        return value == "true"

    def levels(self) -> tuple[Pattern, ...]:
        return parse_patterns(self.patterns) if self.patterns else DEFAULT

    def depth(self) -> int:
        return int(self.recursion_deep_attachments) if self.flag("with_attachments") and self.flag("need_content_analysis") else 0
