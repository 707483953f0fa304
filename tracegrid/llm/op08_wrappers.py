"""HTML extraction by union-free wrappers.

A page is a folded stream of tokens (``page_tree``). The pages of a host are aligned one after the
other: where they agree a token stays, texts that differ become a slot, tokens without a partner
become optional, and neighbours of one kind are a repeated group. What results is a regular
expression without unions, the wrapper of the host. It is inferred from all pages of the host: each
task aligns those that it reads, and the tasks' wrappers are aligned in groups of bounded size
until a host has one.

Each page is then matched against its host's wrapper. A slot whose text is the same on all pages of
a host belongs to the template and goes, if at least ``AGREE`` different pages say so, unless it
stands in a ``main`` or ``article`` element or holds most of the text, as pages that differ in
their frame alone have the same article; slots in
menus, headers, footers, sidebars, notices, adverts, forms and comments go, and so do repeated
groups of links alone. If ``main`` or ``article`` elements hold most of what is left, it is the main
text, else all of it is. A page that does not fit, or has no host, is read with a wrapper of its own.
"""

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .page_tree import INSIDE, SOFT, Item, Known, Page, absorb, broader, by_key, common
from .scratch import Scratch

#: Different pages that make a text that they share a part of the template.
AGREE = 5
#: Share of link characters, and characters of a block on average, by which a group is a menu.
MENU_SHARE, MENU_CHARS = 0.9, 40
#: Forms of pages that a task holds before it aligns them; wrappers aligned in one group, on average.
FORMS, GROUP = 2000, 64
#: Wrappers are handed to tasks while they take no more bytes than this; else joined by host.
HANDED_BYTES = 32 << 20
#: Matches of page forms that a worker keeps.
MATCHES = 20_000

LEARNED = "host string, wrapper string"
RESULT = "url string, text string, n_chars long"


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class Wrapper:
    """A regular expression over tokens, and up to ``AGREE`` digests of pages behind it."""

    def __init__(self, root: Item, pages: set[int]):
        self.root, self.pages = root, pages

    @classmethod
    def of(cls, page: Page) -> "Wrapper":
        for slot in page.root.slots():
            blocks = [page.blocks[i] for i in sorted(slot.texts)]
            text = "\n".join(b.text for b in blocks)
            slot.known = Known(_digest(text), 1, len(blocks), sum(len(b.text) for b in blocks), sum(b.linked for b in blocks))
        return cls(page.root, {_digest("\n".join(b.text for b in page.blocks))})

    def align(self, other: "Wrapper") -> None:
        absorb(self.root, other.root)
        self.pages = set(sorted(self.pages | other.pages)[:AGREE])

    def dump(self) -> str:
        def listed(item: Item) -> list:
            k = item.known
            flags = [item.level, int(item.main), int(item.optional), int(item.repeated), int(item.bag)]
            return [*item.key, flags, k and [k.digest, k.pages, k.blocks, k.chars, k.linked], [listed(p) for p in item.parts]]

        return json.dumps([sorted(self.pages), listed(self.root)], separators=(",", ":"))

    @classmethod
    def load(cls, dumped: str) -> "Wrapper":
        def item(x: list) -> Item:
            name, kinds, (level, main, optional, repeated, bag), known, parts = x
            return Item((name, kinds), level, bool(main), bool(optional), bool(repeated), [item(p) for p in parts], bool(bag), known=known and Known(*known))

        pages, root = json.loads(dumped)
        return cls(item(root), set(pages))

    def kept(self) -> set[int]:
        """The slots, by their place among all slots, that hold main text."""
        slots, menus = [], []

        def walk(item: Item, repeated: bool) -> None:
            repeated |= item.repeated
            if item.key[0] == "#":
                slots.append(item)
                menus.append(repeated)
            for p in item.parts:
                walk(p, repeated)

        walk(self.root, False)
        known = enumerate(zip(slots, menus, strict=True))
        chars = sum(s.known.chars for s in slots if s.level >= SOFT)

        def template(slot: Item, repeated: bool) -> bool:
            k = slot.known
            if len(self.pages) >= AGREE and k.digest is not None and k.pages >= AGREE:
                return not slot.main and 2 * k.chars < chars
            return repeated and not slot.main and k.linked >= MENU_SHARE * k.chars and k.chars < MENU_CHARS * k.blocks

        varying = [i for i, (s, repeated) in known if s.level >= SOFT and not template(s, repeated)]
        found = [i for i in varying if slots[i].level == INSIDE] or varying
        main = [i for i in found if slots[i].main]
        size = lambda places: sum(slots[i].known.chars for i in places)
        return set(main if main and 2 * size(main) >= size(found) else found)

    def match(self, page: Item) -> list[int] | None:
        """For each slot of a page the place of the wrapper's slot; None if the page does not fit."""
        places = {id(s): i for i, s in enumerate(self.root.slots())}
        out = []

        def fit(mine: Item, its: Item) -> bool:
            if mine.key[0] == "#":
                out.append(places[id(mine)])
                return True
            if kinds := by_key(mine.parts):
                if not mine.bag and (its.bag or not by_key(its.parts)):
                    return False
                partners = [next((kinds[k] for k in broader(p.key) if k in kinds), None) for p in its.parts]
            else:
                pairs = common(mine.parts, its.parts)
                partners = [mine.parts[i] for i, _ in pairs] if len(pairs) == len(its.parts) and not its.bag else [None]
            return all(a is not None and fit(a, b) for a, b in zip(partners, its.parts, strict=False))

        return out if fit(self.root, page) else None


def aligned(wrappers: list[Wrapper]) -> Wrapper:
    """One wrapper of several, those of most pages first."""
    weight = lambda w: -max((s.known.pages for s in w.root.slots()), default=0)
    first, *rest = sorted(wrappers, key=lambda w: (weight(w), w.dump()))
    for other in rest:
        first.align(other)
    return first


class Forms:
    """Pages by host and form. Pages of one form differ in texts alone, so they add up."""

    def __init__(self):
        self.by_host: dict[str, dict[str, Wrapper]] = {}
        self.size = 0

    def add(self, host: str, source: str) -> None:
        page = Page(source)
        if not page.blocks:
            return
        new, shape = Wrapper.of(page), page.root.shape()
        forms = self.by_host.setdefault(host, {})
        if shape not in forms:
            self.size += 1
            forms[shape] = new
            return
        for a, b in zip(forms[shape].root.slots(), new.root.slots(), strict=True):
            a.known = a.known.plus(b.known)
        forms[shape].pages = set(sorted(forms[shape].pages | new.pages)[:AGREE])

    def drain(self) -> Iterator[tuple[str, str]]:
        for host, forms in self.by_host.items():
            yield host, aligned(list(forms.values())).dump()
        self.by_host, self.size = {}, 0


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages with text."""
    forms = Forms()
    for p in pages:
        forms.add("", p)
    return Wrapper.load(next(forms.drain())[1])


def main_text(source: str | None, wrapper: Wrapper | None, matches: dict | None = None, kept: set[int] | None = None) -> tuple[str, bool]:
    """The main text of a page, and whether it fits the wrapper."""
    page = Page(source)
    shape = page.root.shape()
    matches = {} if matches is None else matches
    if wrapper and shape not in matches:
        if len(matches) >= MATCHES:
            matches.clear()
        matches[shape] = wrapper.match(page.root)
    places = matches.get(shape) if wrapper else None
    fits = places is not None
    if fits:
        kept = wrapper.kept() if kept is None else kept
    else:
        own = Wrapper.of(page)
        kept, places = own.kept(), range(len(own.root.slots()))
    blocks = {i for slot, place in zip(page.root.slots(), places, strict=True) if place in kept for i in slot.texts}
    return "\n".join(b.text for i, b in enumerate(page.blocks) if i in blocks), fits


def host_of(url) -> F.Column:
    """The host of a URL in lower case; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, wrapper``: the dumped wrapper of each host with text, from all its pages."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()

        def out() -> pa.RecordBatch:
            rows = list(forms.drain())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["host", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                forms.add(host, source)
                if forms.size >= FORMS:
                    yield out()
        yield out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = aligned([Wrapper.load(w) for w in group["wrapper"]])
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [merged.dump()]})

    rows = scratch.put(pages.select("host", "html").where("host IS NOT NULL AND html IS NOT NULL").mapInArrow(learn, LEARNED))
    while True:
        most = rows.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
        if (most or 0) <= 1:
            return rows
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // GROUP)))
        rows = scratch.put(rows.withColumn("part", part).groupBy("host", "part").applyInPandas(merge, LEARNED))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Blocks are joined by a newline; white space inside a block becomes one space. A page without
    main text, or with null or empty html, has an empty text. Pages without a host in their URL are
    read with wrappers of their own. Repeated rows and rows without a page_id are read each, pages
    of any length and depth in time that grows with their length; an empty table gives no rows.
    Other columns are ignored, so their names cannot clash.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "wrappers")
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    learned = wrappers(rows, scratch)
    size = learned.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).head()[0] or 0
    if size <= HANDED_BYTES:
        handed = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in learned.collect()})
        joined = rows.select("page_id", "url", "html", F.col("host").alias("wrapper"))
    else:
        handed = None
        joined = rows.join(learned, "host", "left").select("page_id", "url", "html", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple[Wrapper, set[int], dict]] = {}
        for batch in batches:
            texts = []
            for source, name in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                dumped = handed.value.get(name) if handed else name
                if dumped and name not in loaded:
                    if len(loaded) >= 1000:
                        loaded.clear()
                    wrapper = Wrapper.load(dumped)
                    loaded[name] = wrapper, wrapper.kept(), {}
                wrapper, kept, matches = loaded[name] if dumped else (None, None, None)
                texts.append(main_text(source, wrapper, matches, kept)[0])
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(read, f"page_id {kind}, {RESULT}")
