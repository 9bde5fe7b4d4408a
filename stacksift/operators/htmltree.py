"""A small HTML tree with simple selectors; the one Python helper behind the page operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All nodes inside, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in SILENT:
                stack.extend(reversed(x.children))

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


PART = re.compile(r"""^([a-zA-Z][\w-]*)?((?:\.[\w-]+|\[[\w-]+(?:[*$^]?=(?:'[^']*'|"[^"]*"|[^\]]*))?\])*)$""")
CHECK = re.compile(r"""\.([\w-]+)|\[([\w-]+)(?:([*$^]?)=(?:'([^']*)'|"([^"]*)"|([^\]]*)))?\]""")


@lru_cache(maxsize=1024)
def compound(part: str) -> tuple[str, tuple]:
    """A compound's tag, or "", and its checks (class, attribute, operator, value), worked out once per selector."""
    m = PART.match(part)
    if not m:
        raise ValueError(f"selector {part!r} is not supported")
    checks = [(c[1], c[2], c[3] or "", next((x for x in (c[4], c[5], c[6]) if x is not None), None)) for c in CHECK.finditer(m[2])]
    return (m[1] or "").lower(), tuple(checks)


def fits(node: Node, part: str) -> bool:
    """tag, .class and [attr], [attr=v], [attr*=v], [attr$=v], [attr^=v], in one compound."""
    tag, checks = compound(part)
    if tag and node.tag != tag:
        return False
    for name, attr, how, want in checks:
        if name:
            if name not in node.attrs.get("class", "").split():
                return False
            continue
        have = node.attrs.get(attr)
        if have is None:
            return False
        if want is not None and not {"": have == want, "*": want in have, "$": have.endswith(want), "^": have.startswith(want)}[how]:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in document order that fit one of the comma-listed selectors; a space means "inside"."""
    chains = [s.split() for s in selector.split(",")]

    def hit(node: Node, chain: list[str]) -> bool:
        if not fits(node, chain[-1]):
            return False
        rest, up = chain[:-1], node.parent
        while rest and up is not None:
            if fits(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return [n for n in root.walk() if any(hit(n, c) for c in chains)]


def content_root(tree: Node) -> Node:
    """Where the text is: main, else article, else the block with id content, else body, else all."""
    for selector in ("main", "article", "div[id=content]", "body"):
        found = select(tree, selector)
        if found:
            return found[0]
    return tree
