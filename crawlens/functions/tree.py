"""A page as a list of elements in document order. Each has the interval of what stands inside of it, so that "inside of" is a comparison of numbers.

The tokens are the standard library's. An end tag closes up to its nearest open start tag, or nothing; void elements
hold nothing; a new block ends an open paragraph, and a new item, cell or row the one before it, so that texts do not hold each
other; text of comments does not count. Depth has no bound, and all steps take time in proportion to the page: what is open is known by tag.
"""

from __future__ import annotations

from bisect import bisect_right
from html.parser import HTMLParser

VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
# What an extractor drops, what is never shown, and what frames a page's content.
CHROME = frozenset(["script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "svg"])
INERT = frozenset(["script", "style", "noscript", "template"])
SIDE = frozenset(["nav", "header", "footer", "aside"])
#: Elements that end an open paragraph, and what keeps one open from outside.
BLOCKS = frozenset(
    ["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"]
)
SCOPES = frozenset(["button", "object", "td", "th", "caption", "template", "svg", "html", "body"])
_APART = SCOPES - {"td", "th"}
#: A new element of these closes the open ones beside it, up to what holds them.
ITEMS = {
    "li": (["li"], _APART | {"ul", "ol", "menu"}), "dt": (["dt", "dd"], _APART | {"dl"}), "dd": (["dt", "dd"], _APART | {"dl"}), "option": (["option"], _APART | {"select", "datalist"}),
    "tr": (["tr"], _APART | {"table"}), "td": (["td"], _APART | {"tr", "table"}), "th": (["th"], _APART | {"tr", "table"}),
}


class Tree(HTMLParser):
    """Element 0 is the page. ``inside(i)`` are the numbers of the elements in element i; ``runs`` are its texts, in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parent, self.depth = [""], [{}], [-1], [0]
        self.end, self.first, self.last = [0], [0], [0]
        self.runs: list[str] = []
        self.owner: list[int] = []
        self.started: list[int] = []  # elements before each text
        self._source: dict[int, str] = {}  # texts with character references, as they are written
        self._told = 0
        self._open, self._places = [0], {}  # numbers of the open elements; of each tag the places among them
        self.feed(html)
        self.close()
        self._close(0)
        self.end[0], self.last[0] = len(self.tags), len(self.runs)
        self._by_tag: dict[str, list[int]] = {}
        for i, tag in enumerate(self.tags):
            self._by_tag.setdefault(tag, []).append(i)
        hidden = self.nearest(INERT)
        self._inert = [o if self.tags[o] in INERT else hidden[o] for o in self.owner]
        self._blanks = [" ".join(x.split()) for x in self.runs]

    # building
    def updatepos(self, i, j):
        if self.runs and len(self.runs) > self._told:  # the text just read; lines and columns are not asked for
            self._told = len(self.runs)
            if "&" in (x := self.rawdata[i:j]):
                self._source[self._told - 1] = x
        return j

    def _place(self, tags) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _close(self, place: int) -> None:
        """End all open elements after the given place."""
        while len(self._open) > place + 1:
            i = self._open.pop()
            self._places[self.tags[i]].pop()
            self.end[i], self.last[i] = len(self.tags), len(self.runs)

    def _ended(self, tags, holders) -> None:
        if (at := self._place(tags)) and at >= self._place(holders):
            self._close(at - 1)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._ended(["p"], SCOPES)
        elif tag in ITEMS:
            self._ended(*ITEMS[tag])
        up, i = self._open[-1], len(self.tags)
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.tags.append(tag)
        self.attrs.append(own)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.first.append(len(self.runs))
        self.last.append(len(self.runs))
        self.end.append(i + 1)
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(self._open))
            self._open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if at := self._place([tag]):
            self._close(at - 1)

    def handle_data(self, data):
        self.runs.append(data)
        self.owner.append(self._open[-1])
        self.started.append(len(self.tags))

    # asking
    def __len__(self) -> int:
        return len(self.tags)

    def inside(self, i: int) -> range:
        return range(i + 1, self.end[i])

    def of(self, *tags: str) -> list[int]:
        return sorted(x for t in tags for x in self._by_tag.get(t, ()))

    def next(self, tag: str, i: int) -> int:
        """The first element of a tag inside of i, or -1."""
        every = self._by_tag.get(tag, [])
        at = bisect_right(every, i)
        return every[at] if at < len(every) and every[at] < self.end[i] else -1

    def nearest(self, tags: frozenset[str]) -> list[int]:
        """For each element the number of the nearest one around it with one of the tags, or -1."""
        out = [-1] * len(self.tags)
        for i in range(1, len(self.tags)):
            up = self.parent[i]
            out[i] = up if self.tags[up] in tags else out[up]
        return out

    def raw(self, i: int) -> str:
        """The text that stands in element i itself."""
        return "".join(self.runs[k] for k in range(self.first[i], self.last[i]) if self.owner[k] == i)

    def text(self, i: int) -> str:
        """The text inside of element i, without what its inert elements hold."""
        return " ".join(self._blanks[k] for k in range(self.first[i], self.last[i]) if self._blanks[k] and self._inert[k] <= i)

    def written(self, i: int) -> str:
        """As ``text``, with character references as they stand in the page."""
        return " ".join(" ".join(self._source[k].split()) if k in self._source else self._blanks[k] for k in range(self.first[i], self.last[i]) if self._blanks[k] and self._inert[k] <= i)

    def speaks(self, i: int) -> bool:
        """Whether element i has any text."""
        return any(self._blanks[k] and self._inert[k] <= i for k in range(self.first[i], self.last[i]))

    def outside(self, tags: frozenset[str]) -> str:
        """The page's text that stands in none of the tags."""
        near = self.nearest(tags)
        return " ".join(b for b, o in zip(self._blanks, self.owner) if b and near[o] < 0 and self.tags[o] not in tags)

    def words(self, i: int) -> int:
        """Words inside of element i, whatever holds them."""
        return sum(len(self._blanks[k].split()) for k in range(self.first[i], self.last[i]))

    def places(self) -> list[tuple[int, int]]:
        """Place and end of each element, where elements and texts are counted as one sequence."""
        return [(i + f, e + k) for i, (f, e, k) in enumerate(zip(self.first, self.end, self.last))]
