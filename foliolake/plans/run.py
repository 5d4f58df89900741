"""A run of lines through levels, structure and output as its options say."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import layout, tree
from ..operators.patterns import assign_levels
from ..options import Options
from ..sinks import render as sinks


def parse(lines: DataFrame, options: Options) -> DataFrame:
    """Nodes of lines (doc_id, line_id, text and, where the reader has them, tags and pages)."""
    if "page_id" in lines.columns:
        lines = layout.page_slice(lines, options.pages)
    if options.structure_type == "linear":
        return tree.linear(lines)
    return tree.build_tree(assign_levels(lines, options.levels()))


def render(lines: DataFrame, options: Options) -> DataFrame:
    """The result in the format that is asked for: one row a document."""
    nodes = tree.build_tree(assign_levels(lines, options.levels()))
    if options.return_format == "plain_text":
        return tree.render(nodes)
    if options.return_format in ("html", "tree"):
        return sinks.html_pages(nodes)
    if options.return_format == "collapsed_tree":
        return sinks.collapsed_pages(nodes)
    return sinks.documents(nodes, indent=2 if options.return_format == "pretty_json" else None)
