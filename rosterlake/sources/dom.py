"""A page as a small tree with the few selectors that cards need; used inside Arrow batches only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from rosterlake.sources.html import VOID

_STEP = re.compile(r"([\w-]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def __getitem__(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self, by: str = " ") -> str:
        """All text below, white space collapsed, pieces joined by a separator."""
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(" ".join(k.split()))
            elif k.tag not in ("script", "style"):
                stack += reversed(k.kids)
        return by.join(x for x in out if x)

    def fits(self, step: str) -> bool:
        for tag, id_, cls, attr, how, value in _STEP.findall(step):
            own = self.attrs.get(attr or "class") or ""
            if (tag and tag != self.tag) or (id_ and id_ != self.attrs.get("id")) or (cls and cls not in own.split()):
                return False
            if attr and (attr not in self.attrs or (how == "=" and own != value) or (how == "*=" and value not in own) or (how == "^=" and not own.startswith(value))):
                return False
        return True

    def all(self, selector: str) -> list[Node]:
        """Elements below that fit the last step, with ancestors for the steps before it."""
        *before, last = selector.split()

        def inside(n: Node, steps: list[str]) -> bool:
            while steps and (n := n.parent) is not None:
                if n.fits(steps[-1]):
                    steps = steps[:-1]
            return not steps

        return [n for n in self.walk() if n.fits(last) and inside(n, before)]

    def one(self, selector: str) -> Node | None:
        return next(iter(self.all(selector)), None)

    def said(self, selector: str, attr: str = "") -> str:
        """Text, or an attribute, of the first hit; empty without one."""
        n = self.one(selector)
        return "" if n is None else n[attr] if attr else n.text()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        # rows and cells end where the next one begins
        if tag in ("tr", "td", "th", "option", "li") and self.at.tag == tag:
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    """The page's tree; null or broken HTML gives what can be read."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root
