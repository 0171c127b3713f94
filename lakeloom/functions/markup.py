"""Parsers of markup and prose that need state: captions and tables, sentence chunks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "col", "source"}


class CaptionsAndTables(HTMLParser):
    """Collects the text of captions and of tables of given classes, outside skipped elements.

    A skip holds for everything inside the element that carries it.
    """

    def __init__(self, table_classes: tuple[str, ...] = ("wikitable",), skip_classes: tuple[str, ...] = ("navbox", "metadata")):
        super().__init__(convert_charrefs=True)
        self._tables, self._skips = set(table_classes), set(skip_classes)
        self._open: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        _, wanted, skipped = self._open[-1] if self._open else ("", False, False)
        wanted = wanted or tag in ("caption", "figcaption") or tag == "table" and bool(classes & self._tables)
        skipped = skipped or tag in ("script", "style") or bool(classes & self._skips)
        self._open.append((tag, wanted, skipped))

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return

    def handle_data(self, data):
        if self._open and self._open[-1][1] and not self._open[-1][2] and data.strip():
            self.parts.append(" ".join(data.split()))


@F.pandas_udf(T.StringType())
def captions_and_tables(html: pd.Series) -> pd.Series:
    def read(page):
        if page is None:
            return None
        parser = CaptionsAndTables()
        parser.feed(page)
        parser.close()
        return "\n".join(parser.parts)

    return html.map(read)


def sentence_chunks(text: str, size: int) -> list[str]:
    """Whole sentences joined up to `size` characters; a longer sentence is a chunk of its own."""
    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?।])\s+", text.strip()):
        if out and len(out[-1]) + 1 + len(sentence) <= size:
            out[-1] += " " + sentence
        elif sentence:
            out.append(sentence)
    return out


def chunk_udf(size: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else sentence_chunks(t, size))

    return chunks
