"""Pages as small trees: elements, where each ends, and a hash of everything below it.

The builder is one loop over the tags with a stack, in time that grows with the length of the page: no recursion, no
pattern that is tried again from every place. It closes what browsers close (a paragraph before the next block, an item
before the next one) and ignores end tags without a start.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

# fixed values: element names of the markup language by what they do to the text around them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split())
#: What a start tag closes, up to the nearest element of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    **{t: (frozenset({"dd", "dt"}), frozenset({"dl"})) for t in ("dd", "dt")},
    **{t: (frozenset({"td", "th"}), frozenset({"tr", "table"})) for t in ("td", "th")},
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    **{t: (frozenset({"option"}), frozenset({"select"})) for t in ("option", "optgroup")},
}
_P = frozenset({"p"})
_P_STOPS = frozenset({"table", "td", "th", "caption", "button", "html"})
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character give the replacement character."""
    return unescape(_LONG_NUMBER.sub("�", text)) if "&" in text else text


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): decoded(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


class Page:
    """Elements of a page in the order of their start tags.

    tag, parent, last (number of the last element below), marks (the text of the attributes) and, after ``close``,
    hashes (of name, texts and elements below) and letters (characters of text below). ``pieces`` are (element, text)
    in page order; a text of None stands where a block starts or ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.marks = [""], [0], [0], [""]
        self.pieces: list[tuple[int, str | None]] = []
        self._open, self._names = [0], [""]
        self._read(source)
        while self._open:
            self._end()
        self._sum()

    def _start(self, name: str, rest: str) -> int:
        block = name in BLOCKS
        if block and self._at.get("p"):
            self._close_up_to(_P, _P_STOPS)
        if name in CLOSES:
            self._close_up_to(*CLOSES[name])
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.last.append(node)
        self.marks.append(rest)
        if block:
            self.pieces.append((node, None))
        return node

    def _end(self) -> None:
        node = self._open.pop()
        if self._names.pop() in BLOCKS:
            self.pieces.append((node, None))
        self.last[node] = len(self.tag) - 1

    def _close_up_to(self, names: frozenset, stops: frozenset) -> None:
        """End elements down to the innermost one of ``names``, if no element of ``stops`` was opened after it."""
        deepest = self._deepest(names)
        if deepest > 0 and deepest > self._deepest(stops):
            self._leave(deepest)

    def _deepest(self, names: frozenset) -> int:
        found = 0
        for name in names:
            places = self._at.get(name)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def _leave(self, depth: int) -> None:
        while len(self._open) > depth:
            self._at[self._names[-1]].pop()
            self._end()

    def _read(self, s: str) -> None:
        self._at: dict[str, list[int]] = {}  # depths of the open elements of each name
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.pieces.append((self._open[-1], decoded(s[at:lt])))
            if lt + 1 >= n:
                if lt + 1 == n:
                    self.pieces.append((self._open[-1], "<"))
                return
            c = s[lt + 1]
            if c == "!":
                if s.startswith("<!--", lt):
                    end = lt + 3 if s.startswith(("<!-->", "<!--->"), lt) else s.find("-->", lt + 4)
                    at = n if end < 0 else s.find(">", end) + 1
                    continue
                if s.startswith("<![CDATA[", lt):
                    end = s.find("]]>", lt)
                    self.pieces.append((self._open[-1], s[lt + 9 : n if end < 0 else end]))
                    at = n if end < 0 else end + 3
                    continue
            if c in "!?":
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = c == "/"
            name = _NAME.match(s, lt + 1 + closing)
            if name is None:
                if closing:  # an end tag without a name is left out as far as it goes
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.pieces.append((self._open[-1], "<"))
                    at = lt + 1
                continue
            rest = _REST.match(s, name.end())
            if rest is None:  # the page ends inside a tag
                return
            at = rest.end()
            tag = name[0].lower()
            if closing:
                if self._at.get(tag):
                    self._leave(self._at[tag][-1])
                elif tag == "br":
                    self._start("br", "")
                    self.pieces.append((len(self.tag) - 1, " "))
                continue
            node = self._start(tag, s[name.end() : at - 1])
            if tag in VOID:
                if tag == "br":
                    self.pieces.append((node, " "))
                continue
            self._at.setdefault(tag, []).append(len(self._open))
            self._open.append(node)
            self._names.append(tag)
            if tag in RAW:
                at = self._raw(s, at, tag, node)

    def _raw(self, s: str, at: int, tag: str, node: int) -> int:
        end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
        stop = end.start() if end else len(s)
        if tag in ("textarea", "title"):
            self.pieces.append((node, decoded(s[at:stop])))
        self._leave(len(self._open) - 1)
        close = s.find(">", stop)
        return len(s) if close < 0 else close + 1

    def _sum(self) -> None:
        n = len(self.tag)
        below: list[list[str]] = [[] for _ in range(n)]
        self.letters = [0] * n
        texts: list[list[str]] = [[] for _ in range(n)]
        for node, text in self.pieces:
            if text is not None and (text := " ".join(text.split())):
                texts[node].append(text)
                self.letters[node] += len(text)
        self.hashes = [0] * n
        self.own = [bool(t) for t in texts]
        for node in range(n - 1, -1, -1):  # elements below come later
            if not self.letters[node]:
                continue
            under = below[node]
            under.reverse()
            word = "\0".join([self.tag[node], *texts[node], "", *under])
            self.hashes[node] = number = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            if node:
                up = self.parent[node]
                self.letters[up] += self.letters[node]
                below[up].append(str(number))
