"""HTML to text with a real parser, as an Arrow UDF: for pages whose boilerplate elements nest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without visible text of their own, and elements that begin a line.
SKIPPED = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg")
BLOCKS = ("p", "div", "section", "article", "li", "br", "h1", "h2", "h3", "h4", "pre", "tr")


class Events(HTMLParser):
    """The document as a list of events: `<tag`, `>tag` or text, each with its kind first."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.events.append(("open", tag))
        self.handle_endtag = lambda tag: self.events.append(("close", tag))
        self.handle_data = lambda data: self.events.append(("text", data))
        self.feed(html)
        self.close()


def placed(events: list[tuple[str, str]]) -> Iterator[tuple[str, int, str]]:
    """(where, line, text) of each text event: where is `title`, `hidden` or `body`; lines are numbered by block elements.

    Hidden and title elements are kept on a stack. An end tag closes the innermost element of its name with all that is
    open within it, and means nothing if no such element is open.
    """
    inside: list[str] = []
    line = 0
    for kind, value in events:
        if kind == "text":
            yield "title" if "title" in inside else "hidden" if inside else "body", line, value
        elif value in BLOCKS:
            line += 1
        elif value == "title" or value in SKIPPED:
            if kind == "open":
                inside.append(value)
            elif value in inside:
                del inside[len(inside) - 1 - inside[::-1].index(value) :]


def parsed(html: str | None) -> tuple[str, str]:
    """Title and visible text, a block per line, runs of white space as one blank."""
    found = list(placed(Events(html or "").events))
    title = " ".join("".join(text for where, _, text in found if where == "title").split())
    body = groupby(((line, text) for where, line, text in found if where == "body"), key=lambda x: x[0])
    lines = [" ".join(part.split()) for _, texts in body for part in "".join(t for _, t in texts).split("\n")]
    return title, "\n".join(x for x in lines if x)


def title_and_text(html: Column) -> Column:
    """A struct of title and text."""

    @F.arrow_udf("struct<title:string,text:string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("title", "text"), parsed(x), strict=True)) for x in column.to_pylist()], pa.struct([("title", pa.string()), ("text", pa.string())]))

    return run(html)
