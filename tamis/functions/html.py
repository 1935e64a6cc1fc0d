"""Plain text of web pages.

Every open element has a setting: how deep quotes and lists are, whether text is kept as it stands or not at all. A tag acts by a table:
what it does to the line that is being written, and what setting its content gets. An element that is never closed ends with the one
around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that begin a line of their own, elements without text, and elements that have no end.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 hr dl dt dd table thead tbody tr figure figcaption section article details summary li ul ol pre blockquote".split())
SILENT = frozenset(("script", "style"))
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE, _GAPS = re.compile(r"\s+"), re.compile(r"\n{3,}")


@dataclass(frozen=True)
class Setting:
    """What holds inside an element. `tally` counts a numbered list's items or a row's cells and is shared by its content."""

    tag: str = ""
    quotes: int = 0
    lists: int = 0
    numbered: bool = False
    verbatim: bool = False
    silent: bool = False
    tally: list[int] = field(default_factory=lambda: [0])


#: Settings of an element's content, from those around it.
INSIDE = {
    "blockquote": lambda s: replace(s, quotes=s.quotes + 1),
    "pre": lambda s: replace(s, verbatim=True),
    "ul": lambda s: replace(s, lists=s.lists + 1, numbered=False, tally=[0]),
    "ol": lambda s: replace(s, lists=s.lists + 1, numbered=True, tally=[0]),
    "tr": lambda s: replace(s, tally=[0]),
    **dict.fromkeys(SILENT, lambda s: replace(s, silent=True)),
}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.line, self.mark = [Setting()], [], "", ""

    def finish(self, keep_empty: bool = False) -> None:
        """Puts the line away; a list mark waits for a line that isn't empty."""
        text, self.line = self.line.rstrip(), ""
        if text or keep_empty:
            self.lines.append("> " * self.open[-1].quotes + self.mark + text)
            self.mark = ""

    def bullet(self) -> None:
        around = self.open[-1]
        around.tally[0] += 1
        self.mark = "  " * max(0, around.lists - 1) + (f"{around.tally[0]}. " if around.numbered else "- ")

    def cell(self) -> None:
        tally = self.open[-1].tally
        self.line += " | " if tally[0] else ""
        tally[0] += 1

    def newline(self) -> None:
        self.finish(keep_empty=True)

    ACTS = {"li": bullet, "td": cell, "th": cell, "br": newline}

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.finish()
        if act := self.ACTS.get(tag):
            act(self)
        if tag not in EMPTY:
            self.open.append(replace(INSIDE.get(tag, lambda s: s)(self.open[-1]), tag=tag))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.finish()
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if depth is not None:
            del self.open[depth:]

    def handle_data(self, data):
        now = self.open[-1]
        if now.silent:
            return
        if not now.verbatim:
            words = _SPACE.sub(" ", data)
            self.line += words.lstrip(" ") if self.line[-1:] in ("", " ") else words
            return
        *whole, rest = data.split("\n")
        for part in whole:
            self.line += part
            self.newline()
        self.line += rest


def page_text(html: str | None) -> str:
    """Text of a page or fragment; null and empty pages give the empty text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.finish()
    return _GAPS.sub("\n\n", "\n".join(page.lines)).strip("\n")


#: By rows, not Arrow batches: those hold 10,000 pages at a time, in and out, whatever their size.
html_text = F.udf(page_text, StringType(), useArrow=False)
