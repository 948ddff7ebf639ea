"""Main content of pages by density of text and links over the tree of blocks, as Markdown.

A block is what stands between the edges of elements that begin lines. What it holds besides links counts for every
element around it, less with each level in between; links and scraps count for nothing. The element with the largest
sum is the main one: it holds most prose closely. Its blocks are the content, but for those that are mostly links, with
parts beside it that hold prose of their own and the headings that lead to it. No class or name of an element is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: What a level costs, letters of a scrap, share of links that makes a block a list of them, share of the main sum that a part beside needs.
DECAY, SCRAP, LINKED, BESIDE = 0.7, 25, 0.5, 0.3
#: Elements whose text is not shown, that have no end, that hold one piece of prose, and that begin lines.
HIDDEN = {"script", "style", "noscript", "template", "head"}
VOID = {"br", "img", "meta", "link", "input", "hr", "col", "area", "base", "embed", "source", "track", "wbr"}
SINGLE = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "a", "b", "i", "em", "strong", "span", "u", "code", "font", "small"}
LINES = {"p", "div", "article", "section", "main", "body", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "aside", "header", "footer", "form", "blockquote", "pre", "dl", "dt", "dd", "figure", "title"}


class Blocks(HTMLParser):
    """The blocks of a page: (element, its name, text, letters in links), and the element around each element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.name, self.blocks = [-1], [0], [""], []
        self._open: list[tuple[str, int]] = [("", 0)]
        self._hidden, self._links, self._text, self._linked = 0, 0, [], 0
        self.feed(re.sub(r"</?[A-Za-z][^<>]*\Z", "", html))  # a page may end within a tag
        self.close()
        self._end_block()

    def _end_block(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            tag, node = next((t, n) for t, n in reversed(self._open) if t in LINES or not t)
            self.blocks.append((node, tag, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _pop(self, tag: str) -> None:
        while len(self._open) > 1:
            t, _ = self._open.pop()
            self._hidden -= t in HIDDEN
            self._links -= t == "a"
            if t == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            return
        if tag in LINES:
            self._end_block()
            # a paragraph ends where lines begin, a list item at the next
            inner = lambda: next((t for t, _ in reversed(self._open) if t in LINES), "")
            if inner() == "p":
                self._pop("p")
            if tag == "li" and inner() == "li":
                self._pop("li")
        node = len(self.parent)
        self.parent.append(self._open[-1][1])
        self.name.append(tag)
        self.depth.append(self.depth[self._open[-1][1]] + (tag in LINES))
        self._open.append((tag, node))
        self._hidden += tag in HIDDEN
        self._links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self._open):
            if tag in LINES:
                self._end_block()
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._text.append(data)
            self._linked += len(" ".join(data.split())) if self._links else 0


def main_blocks(page: Blocks) -> list[tuple[int, str, str, int]]:
    """The blocks of the main content, in order."""
    sums: dict[int, float] = {}
    prose = lambda b: len(b[2]) - b[3] if len(b[2]) - b[3] >= SCRAP and b[3] <= LINKED * len(b[2]) else 0
    for b in page.blocks:
        node, weight = b[0], float(prose(b))
        while weight and node >= 0:
            sums[node] = sums.get(node, 0.0) + weight
            up = page.parent[node]
            weight *= DECAY if up >= 0 and page.depth[up] < page.depth[node] else 1.0
            node = up
    if not sums:
        return []
    # of equal sums the innermost, which comes last
    main = max((n for n in sums if page.name[n] not in SINGLE), key=lambda n: (round(sums[n], 6), n))
    beside = {n for n, s in sums.items() if page.parent[n] == page.parent[main] and s >= BESIDE * sums[main]} | {main}

    def within(node: int) -> bool:
        while node >= 0 and node not in beside:
            node = page.parent[node]
        return node >= 0

    begun = next(i for i, b in enumerate(page.blocks) if within(b[0]))
    leads = {i for i in range(begun) if re.fullmatch("h[1-6]", page.blocks[i][1]) and all(re.fullmatch("h[1-6]", b[1]) for b in page.blocks[i:begun])}
    return [b for i, b in enumerate(page.blocks) if i in leads or within(b[0]) and b[3] <= LINKED * len(b[2])]


def markdown(html: str) -> str:
    """The main content of a page: headings, list items and paragraphs; empty where a page has no prose."""
    out = []
    for _, tag, text, _ in main_blocks(Blocks(html)):
        out.append(f"{'#' * int(tag[1])} {text}" if re.fullmatch("h[1-6]", tag) else f"- {text}" if tag == "li" else text)
    return "\n\n".join(out)


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, markdown) of raw pages (page_id, html); null html is empty. A page is read whole, by the task that has its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "markdown": [markdown(h or "") for h in b.html]})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, markdown string")
