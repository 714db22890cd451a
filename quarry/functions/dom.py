"""A forgiving HTML tree with the selectors that result pages need, and its
text as Markdown.  Used inside Arrow-batched functions only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

from quarry.functions.lexicon import DROPPED_TAGS

# Elements without content, and elements that a sibling closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tbody", "thead", "blockquote", "body", "html", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> Iterator[Node]:
        """All elements below, in order of the document."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack.extend(reversed(n.children))

    def text(self, between: str = " ") -> str:
        return between.join(t for t in (x.strip() for x in self.texts()) if t)

    def select(self, selector: str) -> list[Node]:
        wanted = _compiled(selector)
        return [n for n in self.elements() if any(_matches(n, chain, self) for chain in wanted)]

    def first(self, selector: str) -> Node | None:
        wanted = _compiled(selector)
        return next((n for n in self.elements() if any(_matches(n, chain, self) for chain in wanted)), None)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


_SIMPLE = re.compile(r":nth-child\((\d+)\)|([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)'([^']*)')?\]")


@functools.cache
def _compiled(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """For each alternative its compounds from the last one back, each with the
    combinator to the one before it; a leading ">" means a child of the top."""
    out = []
    for part in selector.split(","):
        chain, combinator = [], " "
        for token in part.replace(">", " > ").split():
            if token == ">":
                combinator = ">"
            else:
                chain.append((combinator, _SIMPLE.findall(token)))
                combinator = " "
        out.append(chain[::-1])
    return out


def _is(n: Node, tests: list[tuple]) -> bool:
    for nth, tag, cls, id_, attr, op, value in tests:
        if nth and (n.parent is None or next(islice((c for c in n.parent.children if isinstance(c, Node)), int(nth) - 1, None), None) is not n):
            return False
        if tag and n.tag != tag.lower() or cls and not n.has_class(cls) or id_ and n.attrs.get("id") != id_:
            return False
        if attr and (attr not in n.attrs or op == "=" and n.attrs[attr] != value or op == "*=" and value not in n.attrs[attr]):
            return False
    return True


def _matches(n: Node, chain: list[tuple[str, list[tuple]]], top: Node) -> bool:
    if not _is(n, chain[0][1]):
        return False
    if len(chain) == 1:
        return chain[0][0] != ">" or n.parent is top
    up = n.parent
    while up is not None:
        if _matches(up, chain[1:], top):
            return True
        if chain[0][0] == ">":
            return False
        up = up.parent
    return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def dom_title(html: str) -> str | None:
    """The first line that is not blank of the first title, else of an h1."""
    tree = parse(html)
    for tag in ("title", "h1"):
        for n in tree.select(tag):
            lines = "".join(n.texts()).splitlines()
            if lines and lines[0].strip():
                return lines[0].strip()
    return None


def markdown(html: str) -> str:
    """Headings, lists, links, emphasis, code and tables as Markdown; blocks
    are apart by a blank line; images and what is no text of the page go."""
    out: list[str] = []
    line: list[str] = []

    def flush(gap: bool = True) -> None:
        text = re.sub(r"[ \t\r\n]+", " ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)
        if gap and out and out[-1]:
            out.append("")

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                line.append(c)
            elif c.tag in DROPPED_TAGS or c.tag == "img":
                continue
            elif c.tag == "br":
                flush(False)
            elif c.tag == "pre":
                flush()
                out.extend(["```", "".join(c.texts()).strip("\n"), "```", ""])
            elif c.tag == "li":
                flush(False)
                line.append("- ")
                walk(c)
                flush(False)
            elif c.tag == "tr":
                flush(False)
                cells = [x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                out.append("| " + " | ".join(x.text() for x in cells) + " |")
                if any(x.tag == "th" for x in cells):
                    out.append("| " + " | ".join("---" for _ in cells) + " |")
            elif c.tag == "a" and c.attrs.get("href") and c.text():
                line.append(f"[{c.text()}]({c.attrs['href']})")
            elif c.tag in ("b", "strong") and c.text():
                line.append(f"**{c.text()}**")
            elif c.tag in BLOCKS:
                flush()
                if re.fullmatch("h[1-6]", c.tag):
                    line.append("#" * int(c.tag[1]) + " ")
                walk(c)
                flush()
            else:
                walk(c)

    walk(parse(html))
    flush()
    return "\n".join(out).strip()
