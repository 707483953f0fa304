"""Pages as folded token streams.

A page is read once from front to back into items: an item is a tag with the tokens it holds, or a
text slot (key ``#``). Neighbours of the same kind are folded to one repeated item as soon as they
close, so a page of a thousand paragraphs has one paragraph item. The blocks of text stay in page
order beside the items, each with the number of its slot.

Reading is forgiving and linear: unclosed paragraphs and list items end where HTML ends them,
nothing is read twice, and elements nested deeper than ``DEPTH`` belong to the one at that depth.
"""

import html
import re
from collections import Counter
from dataclasses import dataclass, field

DEPTH = 60
#: Children that an item lists in order; with more kinds side by side, each kind is listed once.
LISTED = 40

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count only behind an equals sign.
_REST = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')|=)*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']++)))?""")
_NAMES = re.compile(r"[A-Za-z][\w-]*")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg iframe title".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_EDGES = {"ul", "ol", "dl", "table", "select"}
TRANSPARENT = {"html", "head", "body"}
EDGES = ENDS_PARAGRAPH - {"p"}
CELL_EDGES = EDGES - {f"h{i}" for i in range(1, 7)} | {"li", "td", "th"}

#: Elements, and names of classes and ids, that mark what is not main text.
OUTSIDE = set("nav footer aside form button select dialog menu".split())
OUTSIDE_NAMES = set("ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social footer masthead comment comments respond disqus login signup search complementary contentinfo toolbar pagination pager".split())
#: Second words with which a first word from above still names a part of the page's frame.
PARTS = set("list item items box wrap wrapper container inner outer area section bar left right links link body form slot unit block buttons button posts post signup top bottom icons column col panel row thread text message header title".split())
#: Words of layout classes, as in ``content-with-sidebar``.
LAYOUT = {"with", "has", "no", "without"}

HARD, SOFT, INSIDE = 0, 1, 2


def marks_outside(name: str, in_main: bool = False) -> bool:
    """Whether a class or id names something that holds none of the main text: the whole name,
    its last word, or its first before a word like ``list``. The last word alone says nothing
    inside of the main text, where it can name what a paragraph is about."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or not LAYOUT.isdisjoint(words):
        return False
    if len(words) == 1:
        return words[0] in OUTSIDE_NAMES
    return words[-1] in OUTSIDE_NAMES and not in_main or words[0] in OUTSIDE_NAMES and words[1] in PARTS


@dataclass
class Known:
    """The texts of a slot over pages; ``digest`` is None where they differ."""

    digest: int | None
    pages: int
    blocks: int
    chars: int
    linked: int

    def plus(self, other: "Known") -> "Known":
        digest = self.digest if self.digest == other.digest else None
        return Known(digest, self.pages + other.pages, self.blocks + other.blocks, self.chars + other.chars, self.linked + other.linked)


@dataclass
class Item:
    """A tag (or ``#``), what it holds, and what is known of its text."""

    key: tuple[str, str]
    level: int = INSIDE
    main: bool = False
    optional: bool = False
    repeated: bool = False
    parts: list["Item"] = field(default_factory=list)
    bag: bool = False  # parts in any order and number, each kind listed once
    texts: list[int] = field(default_factory=list)  # of a page: its blocks in this slot
    known: "Known | None" = None  # of a wrapper: what its pages have in this slot

    def slots(self) -> list["Item"]:
        if self.key[0] == "#":
            return [self]
        return [s for p in self.parts for s in p.slots()]

    def shape(self) -> str:
        """The folded tokens, by which pages of one form are known."""
        if self.key[0] == "#":
            return "#"
        inner = "".join(p.shape() for p in self.parts)
        return f"<{self.key[0]} {self.key[1]} {self.level}{self.main:d}{self.bag:d}{self.repeated:d}>{inner}</>"

    def show(self) -> str:
        inner = "#" if self.key[0] == "#" else f"<{self.key[0]}>{'|'.join(p.show() for p in self.parts) if self.bag else ''.join(p.show() for p in self.parts)}"
        return f"({inner})" + "+" * self.repeated + "?" * self.optional if self.repeated or self.optional else inner


def broader(key: tuple[str, str]) -> list[tuple[str, str]]:
    """A key, then without its classes, then without its tag; the marks of its level stay."""
    level = key[1][len(key[1].rstrip("!")) :]
    return [key, (key[0], level), ("*", level)] if key[0] != "#" else [key] * 3


def bagged(parts: list[Item]) -> list[Item]:
    """One part for each kind, in the order in which kinds appear. Kinds are told apart by tag and
    classes, by tags once they are many, and by level once these are many."""
    for step in range(3):
        kinds: dict[tuple[str, str], Item] = {}
        for p in parts:
            p.optional, p.key = True, broader(p.key)[step]
            if p.key in kinds:
                absorb(kinds[p.key], p)
                kinds[p.key].repeated = True
            else:
                kinds[p.key] = p
        parts = list(kinds.values())
        if len(parts) <= 2 * LISTED:
            break
    return parts


def common(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of items by key, as pairs of places."""
    n, m = len(a), len(b)
    if [x.key for x in a] == [y.key for y in b]:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i].key == b[j].key:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def absorb(into: Item, other: Item) -> None:
    """Align two items of the same key: ``into`` then matches what either did. What only one has
    becomes optional; ``other`` must not be used afterwards."""
    into.optional |= other.optional
    into.repeated |= other.repeated
    into.texts += other.texts
    if into.key[0] == "#":
        into.known = into.known.plus(other.known) if into.known and other.known else into.known or other.known
        return
    if into.bag or other.bag:
        into.parts, into.bag = bagged(into.parts + other.parts), True
        return
    if by_key(into.parts) and by_key(other.parts):
        merge_by_key(into, other)
    else:
        merge_in_order(into, other)
    if len(into.parts) > LISTED:
        into.parts, into.bag = bagged(into.parts), True


def by_key(parts: list[Item]) -> dict[tuple[str, str], Item]:
    """Parts by key; nothing if a key occurs twice."""
    found = {p.key: p for p in parts}
    return found if len(found) == len(parts) else {}


def merge_by_key(into: Item, other: Item) -> None:
    """Parts of one kind are one part wherever they stand; new ones follow the one before them."""
    mine, theirs, at = by_key(into.parts), by_key(other.parts), 0
    for p in into.parts:
        p.optional |= p.key not in theirs
    for p in other.parts:
        if p.key in mine:
            absorb(mine[p.key], p)
            at = next(i for i, x in enumerate(into.parts) if x is mine[p.key]) + 1
        else:
            p.optional = True
            into.parts.insert(at, p)
            at += 1


def merge_in_order(into: Item, other: Item) -> None:
    parts, i, j = [], 0, 0
    for x, y in [*common(into.parts, other.parts), (len(into.parts), len(other.parts))]:
        for p in into.parts[i:x] + other.parts[j:y]:
            p.optional = True
            parts.append(p)
        if x < len(into.parts):
            absorb(into.parts[x], other.parts[y])
            parts.append(into.parts[x])
        i, j = x + 1, y + 1
    into.parts = parts


@dataclass
class Block:
    text: str
    linked: int  # characters inside of links


class Page:
    """The items of a page under ``root`` and its ``blocks`` in page order."""

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        self.root = Item(("", ""))
        self._stack = [("", self.root)]
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(source or "")
        self._end_block()
        while len(self._stack) > 1:
            self._pop()
        if self.root.bag:
            self.root.parts = bagged(self.root.parts)

    def _end_block(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            item = self._stack[-1][1]
            slot = item.parts[-1] if item.parts and item.parts[-1].key[0] == "#" else None
            if slot is None:
                slot = Item(("#", ""), item.level, item.main)
                item.parts.append(slot)
            else:
                slot.repeated = True
            slot.texts.append(len(self.blocks))
            self.blocks.append(Block(text, min(self._linked, len(text))))
            self._shorten(item)
        self._text.clear()
        self._linked = 0

    def _shorten(self, item: Item) -> None:
        if len(item.parts) > (2 * LISTED if item.bag else LISTED):
            item.parts, item.bag = bagged(item.parts), True

    def _fold_last(self, item: Item) -> None:
        """Fold the part that closed last into the one before it if both are of one kind."""
        parts = item.parts
        if len(parts) > 1 and parts[-1].key == parts[-2].key:
            absorb(parts[-2], parts.pop())
            parts[-1].repeated = True
        self._shorten(item)

    def _pop(self) -> None:
        name, item = self._stack.pop()
        self._open[name] -= 1
        above = self._stack[-1][1]
        if item is above:
            return
        if item.bag:
            item.parts = bagged(item.parts)
        if item.parts:
            self._fold_last(above)
        else:  # it holds no text
            above.parts.pop()

    def _close(self, names: set[str], edges: set[str]) -> None:
        if not any(self._open[n] for n in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in edges:
                return

    def _open_element(self, name: str, rest: str) -> None:
        if name in ENDS_PARAGRAPH:
            self._close({"p"}, CELL_EDGES)
        if name in SELF_CLOSING:
            self._close(SELF_CLOSING[name], LIST_EDGES)
        if name in VOID or name in TRANSPARENT:
            return
        above = self._stack[-1][1]
        item = self._new_item(name, rest, above)
        if len(self._stack) > DEPTH and item.level == above.level:
            item = above
        else:
            above.parts.append(item)
        self._open[name] += 1
        self._stack.append((name, item))

    def _new_item(self, name: str, rest: str, above: Item) -> Item:
        level, kinds = above.level, []
        if name in OUTSIDE or name == "header" and not above.main:
            level = HARD
        if len(rest) > 3:
            marked = False
            for m in _ATTRIBUTE.finditer(rest):
                attribute = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if attribute in ("class", "id", "role"):
                    names = _NAMES.findall(value)
                    marked = marked or any(marks_outside(n, above.main) for n in names)
                    if attribute == "class":
                        kinds += [re.sub(r"\d{3,}", "", n) for n in names]
                elif attribute == "hidden" or attribute == "style" and "display:none" in value.replace(" ", "").lower():
                    marked = True
            if marked and name not in ("main", "article"):
                level = min(level, SOFT)
        main = level == INSIDE and (above.main or name in ("main", "article"))
        return Item((name, " ".join(sorted(set(kinds))) + "!" * (INSIDE - level)), level, main)

    def _read(self, source: str) -> None:
        at, text_from, loose = 0, 0, False
        while True:
            at = source.find("<", at)
            if at < 0:
                break
            name = _NAME.match(source, at + 1)
            if not name and source[at + 1 : at + 2] not in ("!", "?"):
                at += 1
                continue
            if name:
                rest = _REST.match(source, name.end())
                end = rest.end() if rest else source.find(">", name.end()) + 1
            elif source.startswith("<!--", at):
                end = source.find("-->", at + 4) + 3
                end = len(source) if end == 2 else end
            else:
                end = source.find(">", at) + 1
            if not end:  # no tag ends any more: the rest is text
                break
            if at > text_from:
                self._add(source[text_from:at])
            if name:
                end = self._tag(source, name[0].lower(), source[name.end() : end - 1], end)
            at = text_from = end
        self._add(source[text_from:])

    def _add(self, text: str) -> None:
        text = html.unescape(text)
        self._text.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _tag(self, source: str, name: str, rest: str, end: int) -> int:
        """Take one tag; returns where to read on."""
        if name in RAW:
            if name in ("textarea", "iframe", "svg"):
                self._text.append(" ")
            if rest.endswith("/"):
                return end
            close = re.compile(f"</{name}[^>]*>", re.I).search(source, end)
            return close.end() if close else len(source)
        bare = name.removeprefix("/")
        if bare == "a":
            self._in_link = name == "a"
        if bare in INLINE:
            if bare in VOID:
                self._text.append(" ")
            return end
        if bare in TRANSPARENT:
            return end
        self._end_block()
        if name == bare:
            self._open_element(name, rest)
        elif name != "/p" or self._open["p"]:
            self._close({bare}, set() if bare in ENDS_PARAGRAPH else EDGES)
        return end
