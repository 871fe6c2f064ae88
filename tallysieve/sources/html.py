"""A small HTML tree for pages that are not well-formed, on the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open one of the same group.
SIBLINGS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HIDDEN = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, tag: str, cls: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and (cls is None or cls in n.classes())), None)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in HIDDEN:
                stack += reversed(item.children)

    def text(self, sep: str = "") -> str:
        """Stripped non-empty strings, joined."""
        return sep.join(s for s in (t.strip() for t in self.strings()) if s)

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, at = SIBLINGS.get(tag, ()), self.open
        while at.tag and at.tag in ends:
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, at)
        at.children.append(node)
        self.open = at if tag in VOID else node

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.tag and at.tag != tag:
            at = at.parent
        if at.tag == tag and at.parent is not None:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
