"""XML and HTML documents as node tables.

Elements, attributes, attribute values and texts become nodes, labelled by one depth-first walk: a counter gives start on
entry and end on exit, the root has level 1. The root's own attributes are left out; attributes come before an element's
children, in ascending order of name, each a node with its value as only child; texts are trimmed, blank ones and comments
dropped; all names and texts but the root's name are cut to `width` characters (None: not at all). CDATA sections are part
of the text around them and instructions are dropped; with `marked`, both have a text node of their own for what they hold,
followed by a node with their name (#cdata-section, or the instruction's target).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from copse.sources.schema import NODE

WIDTH = 5
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Labeller:
    """Collects nodes in the order of their starts."""

    def __init__(self, width: int | None) -> None:
        self.width, self.count = width, 0
        self.rows: list[list] = []
        self.open: list[int] = []

    def enter(self, tag: str, kind: str) -> None:
        self.count += 1
        path = [self.rows[i][0] for i in self.open]
        name = tag if not self.open and kind == "element" else tag[: self.width]
        self.open.append(len(self.rows))
        self.rows.append([self.count, 0, len(self.open), name, kind, path[-1] if path else None, path])

    def leave(self) -> None:
        self.count += 1
        self.rows[self.open.pop()][1] = self.count

    def leaf(self, tag: str, kind: str) -> None:
        self.enter(tag, kind)
        self.leave()

    def attributes(self, found: dict[str, str]) -> None:
        for name in sorted(found):
            self.enter(name, "attribute")
            self.leaf(found[name], "value")
            self.leave()

    def text(self, text: str) -> None:
        if self.open and (text := text.strip()):
            self.leaf(text, "text")


def shred_xml(text: str, width: int | None = WIDTH, marked: bool = False) -> list[list]:
    """Rows start, end, level, tag, kind, parent_start, ancestors of a well-formed document; else an error."""
    out, parser, pending = Labeller(width), expat.ParserCreate(), []
    parser.buffer_text = True

    def settle() -> None:
        out.text("".join(pending))
        pending.clear()

    def enter(name: str, attributes: dict[str, str]) -> None:
        settle()
        root = not out.open
        out.enter(name, "element")
        if not root:
            out.attributes(attributes)

    def leave(name: str) -> None:
        settle()
        out.leave()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = enter, leave, pending.append
    parser.CommentHandler = lambda _: settle()

    def end_section() -> None:
        settle()
        if out.open:
            out.leaf("#cdata-section", "section")

    def instruction(target: str, data: str) -> None:
        settle()
        if out.open:
            out.text(data)
            out.leaf(target, "instruction")

    if marked:
        parser.StartCdataSectionHandler, parser.EndCdataSectionHandler, parser.ProcessingInstructionHandler = settle, end_section, instruction
    parser.Parse(text, True)
    return out.rows


class _Html(HTMLParser):
    def __init__(self, out: Labeller) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.names, self.pending = out, [], []

    def settle(self) -> None:
        self.out.text("".join(self.pending))
        self.pending.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.settle()
        self.out.enter(tag, "element")
        self.out.attributes({k: v or "" for k, v in attrs})
        self.names.append(tag)
        if tag in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.settle()
        if tag in self.names[1:]:
            while True:
                self.out.leave()
                if self.names.pop() == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.names[-1] not in ("script", "style"):
            self.pending.append(data)


def shred_html(text: str, width: int | None = None) -> list[list]:
    """The same for tag soup, under a root node `page`; scripts and styles have no text, unclosed elements end with the page."""
    out = Labeller(width)
    parser = _Html(out)
    parser.names.append("page")
    out.enter("page", "element")
    parser.feed(text)
    parser.close()
    parser.settle()
    while out.open:
        out.leave()
    return out.rows


def _shredder(kind: str, width: int | None, marked: bool):
    shred = partial(shred_xml, marked=marked) if kind == "xml" else shred_html

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                rows = [[d, *r] for d, t in zip(part["doc_id"], part["text"], strict=True) if t for r in shred(t, width)]
                yield pd.DataFrame(rows, columns=NODE.names).astype({"parent_start": "Int32"})

    return run


def shred(documents: DataFrame, kind: str = "xml", width: int | None = WIDTH, marked: bool = False) -> DataFrame:
    """The node table of documents (doc_id, text); null and empty texts have no node. One document is one row, never split."""
    from copse.ship import ship

    ship(documents.sparkSession)
    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInPandas(_shredder(kind, width, marked), NODE)


def read_xml(spark: SparkSession, path: str, width: int | None = WIDTH) -> DataFrame:
    """Whole XML files as documents, numbered by a hash of their names."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    return shred(files, "xml", width)
