"""A small document tree over the standard HTML parser, and the facts that need a tree.

What text patterns can express is done with Spark expressions on the page text; this
module serves what needs elements: selectors, siblings, and attributes (H3, H4, H6-H10).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import merge
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

from .patterns import KEYWORDS, PRICE

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}
_PRICE = re.compile(PRICE)
_ENGINE = re.compile("engine|motor", re.I)
_PAGERS = {"pagination", "pager", "page-nav"}
_LOW_WORDS = {field: tuple(w.lower() for w in words) for field, words in KEYWORDS.items()}


#: Elements that a page's functions may look at: so many, and so many times the page's own number.
MOST_STEPS, STEPS_PER_ELEMENT = 1_000_000, 200


class PageTooComplex(ValueError):
    """A page whose nesting asks for more work than any page of its size should."""


class Text:
    """The strings of a page in document order, as they are and stripped; elements are slices of it.

    What scripts, styles and templates hold is a text of its own, so it is in no outer slice.
    """

    def __init__(self):
        self.pieces: tuple[list[str], list[str]] = ([], [])
        self.length = (0, 0)
        self.found: dict[str, list[tuple[int, list[int]]] | None] = {}

    def add(self, piece: str) -> None:
        stripped = piece.strip()
        self.pieces[0].append(piece)
        self.pieces[1].append(stripped)
        self.length = (self.length[0] + len(piece), self.length[1] + len(stripped))

    def close(self) -> None:
        self.raw, self.stripped = map("".join, self.pieces)
        self.low = self.stripped.lower()

    def keyword_places(self, field: str) -> list[tuple[int, list[int]]] | None:
        """Per keyword its length and all its places in the stripped text; None if lower-casing moves places."""
        if field not in self.found:
            low = self.low
            places = []
            for word in _LOW_WORDS.get(field, ()):
                starts, at = [], -1
                while (at := low.find(word, at + 1)) >= 0:
                    starts.append(at)
                if starts:
                    places.append((len(word), starts))
            self.found[field] = places if len(low) == len(self.stripped) else None
        return self.found[field]


class Page:
    """All elements in document order: an element's descendants are the ones from its number to its end."""

    def __init__(self):
        self.order: list[Node] = []
        self.named: dict[str, list[int]] = {}
        self.low_classes: set[str] = set()
        self.texts: list[Text] = []
        self.steps = 0

    def spend(self, steps: int) -> None:
        self.steps += steps
        if self.steps > MOST_STEPS + STEPS_PER_ELEMENT * len(self.order):
            raise PageTooComplex(f"over {MOST_STEPS + STEPS_PER_ELEMENT * len(self.order)} steps for {len(self.order)} elements")


class Node:
    __slots__ = ("attributes", "children", "end", "enter", "in_pager", "leave", "low_class", "name", "number", "page", "parent", "place", "row", "texts")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None, page: Page, texts: Text):
        self.name, self.attributes, self.parent, self.page, self.texts = name, attributes, parent, page, texts
        self.children: list[Node | str] = []
        self.number = self.end = len(page.order)
        self.enter = self.leave = texts.length
        self.low_class = attributes["class"].lower() if "class" in attributes else ""
        self.place = len(parent.children) if parent else 0
        self.row = None if parent is None else parent if parent.name == "tr" else parent.row
        self.in_pager = parent is not None and (parent.in_pager or "pag" in parent.low_class and not _PAGERS.isdisjoint(parent.classes()))
        page.low_classes.add(self.low_class)
        page.order.append(self)
        page.named.setdefault(name, []).append(self.number)

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for n in range(self.number + 1, self.end):
            self.page.spend(1)
            yield self.page.order[n]

    def below(self) -> list[Node]:
        """All elements below at once."""
        self.page.spend(self.end - self.number - 1)
        return self.page.order[self.number + 1 : self.end]

    def text(self) -> str:
        self.page.spend((self.leave[0] - self.enter[0]) >> 6)
        return self.texts.raw[self.enter[0] : self.leave[0]]

    def joined(self) -> str:
        """All strings stripped and put together."""
        self.page.spend((self.leave[1] - self.enter[1]) >> 6)
        return self.texts.stripped[self.enter[1] : self.leave[1]]

    def find(self, *names: str) -> Node | None:
        return next(self.all(*names), None)

    def all(self, *names: str, part: str | None = None) -> Iterator[Node]:
        """Elements of the given names (any if none) with a class that contains ``part``."""
        if part is not None and not any(part in c for c in self.page.low_classes):
            self.page.spend(sum(len(self.numbers(name)) for name in names) if names else self.end - self.number - 1)
            return
        for node in self.of_names(*names) if names else self.walk():
            if part is None or node.class_has(part):
                yield node

    def numbers(self, name: str) -> range:
        """Where in the page's list of a name the elements below stand."""
        held = self.page.named.get(name, [])
        return range(bisect_left(held, self.number + 1), bisect_left(held, self.end))

    def of_names(self, *names: str) -> Iterator[Node]:
        def below(name: str) -> Iterator[int]:
            numbers = self.page.named.get(name, [])
            for at in range(bisect_left(numbers, self.number + 1), len(numbers)):
                if numbers[at] >= self.end:
                    return
                yield numbers[at]

        for n in below(names[0]) if len(names) == 1 else merge(*map(below, names)):
            self.page.spend(1)
            yield self.page.order[n]

    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def class_has(self, part: str) -> bool:
        """Whether a class contains a part (which has no white space, so the whole attribute tells)."""
        return part in self.low_class

    def next_sibling(self, *names: str) -> Node | None:
        siblings = self.parent.children if self.parent else []
        for n in range(self.place + 1, len(siblings)):
            self.page.spend(1)
            if isinstance(siblings[n], Node) and siblings[n].name in names:
                return siblings[n]
        return None

    def holds_keyword(self, field: str) -> bool:
        """Whether the stripped text holds a keyword of a field: by the keywords' places in the whole text."""
        places = self.texts.keyword_places(field)
        if places is None:
            return has_keyword(self.joined(), field)
        if not places:
            return False
        enter, leave = self.enter[1], self.leave[1]
        for length, starts in places:
            at = bisect_left(starts, enter)
            if at < len(starts) and starts[at] + length <= leave:
                return True
        return False


#: Tags written as most are: lower-case names, quoted attributes without references. No element whose content is no markup.
_PLAIN_START = re.compile(r'<(?!(?:script|style|title|textarea|iframe|xmp|plaintext|no\w+)\b)([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&]*")*)>')
_PLAIN_END, _PLAIN_ATTRIBUTES = re.compile("</([a-z][a-z0-9]*)>"), re.compile('([a-z][a-z-]*)="([^"]*)"')


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.texts = [self._text()]
        self.root = self.at = Node("", {}, None, self.page, self.texts[0])
        self.open: Counter[str] = Counter()

    def _text(self) -> Text:
        self.page.texts.append(Text())
        return self.page.texts[-1]

    def _new(self, tag, attrs) -> Node:
        if tag in _HIDDEN and tag not in _VOID:
            self.texts.append(self._text())
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.page, self.texts[-1])
        self.at.children.append(node)
        return node

    def parse_starttag(self, i):
        """Tags written as most are go a short way, to the same end."""
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], _PLAIN_ATTRIBUTES.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def updatepos(self, i, j):
        """Lines are not counted: nothing here reads them."""
        return j

    def _leave(self) -> None:
        node = self.at
        node.end, node.leave = len(self.page.order), node.texts.length
        if node.name in _HIDDEN:
            self.texts.pop()
        self.open[node.name] -= 1
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        node = self._new(tag, attrs)
        if tag in _VOID:
            node.end = len(self.page.order)
        else:
            self.open[tag] += 1
            self.at = node

    def handle_startendtag(self, tag, attrs):
        node = self._new(tag, attrs)
        node.end = len(self.page.order)
        if tag in _HIDDEN:
            self.texts.pop()

    def handle_endtag(self, tag):
        if self.open[tag] > 0:
            while self.at.name != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        self.at.children.append(data)
        self.texts[-1].add(data)

    def finish(self) -> Node:
        while self.at.parent is not None:
            self._leave()
        self.root.end, self.root.leave = len(self.page.order), self.root.texts.length
        for text in self.page.texts:
            text.close()
        return self.root


def parse(html: str | Node | None) -> Node:
    """The tree of a page; of a page that is parsed already, its tree with no steps spent."""
    if isinstance(html, Node):
        html.page.steps = 0
        return html
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.finish()


def has_keyword(text: str, field: str) -> bool:
    low = text.lower()
    return any(k in low for k in _LOW_WORDS.get(field, ()))


def by_keyword(node: Node, field: str, tag: str | None = None, part: str | None = None) -> list[Node]:
    """H3: elements whose text holds a keyword of a field."""
    if tag or part:
        return [x for x in node.all(*([tag] if tag else []), part=part.lower() if part else None) if x.holds_keyword(field)]
    return [x for x in node.below() if x.holds_keyword(field)]


#: Fixed: elements that label a value, and elements that may hold it when they follow.
LABELS, VALUES = ("dt", "th", "label"), ("dd", "td", "span", "div")


def _labelled(root: Node, field: str) -> Iterator[str]:
    """What stands behind labels: all labels' next elements first, then the first cells of headers' rows."""
    labels = [x for x in root.all(*LABELS) if x.holds_keyword(field)]
    beside = (x.next_sibling(*VALUES) for x in labels)
    yield from (x.joined() for x in beside if x is not None)
    cells = (x.row.find("td") for x in labels if x.name == "th" and x.row is not None)
    yield from (x.joined() for x in cells if x is not None)


_WRITTEN = {field: re.compile(rf"(?:{'|'.join(map(re.escape, words))})\s*:?\s*([^\n\r<]+)", re.IGNORECASE) for field, words in KEYWORDS.items()}


def _written(text: str, field: str, low: str | None) -> re.Match | None:
    """The leftmost "label: value". Lower-casing tells where ASCII text has a label at all, so where a match can begin."""
    if low is None:
        return _WRITTEN[field].search(text)
    starts = [at for word in _LOW_WORDS[field] if (at := low.find(word)) >= 0]
    if not starts:
        return None
    first = min(starts)
    return _WRITTEN[field].match(text, first) or _WRITTEN[field].search(text, first + 1)


def field_value(root: Node, field: str, text: str, low: str | None = None) -> str | None:
    """X34: "label: value" in the text, else what a labelling element labels. ``low`` is an ASCII text in lower case."""
    words = KEYWORDS.get(field, ())
    if not words:
        return None
    found = _written(text, field, text.lower() if low is None and text.isascii() else low)
    written = re.sub(r"\s+", " ", found[1].strip()) if found else ""
    if written and written not in words:
        return written
    return next(filter(None, _labelled(root, field)), None)


# List pages.

#: Fixed: selectors of vehicle cards, in the order in which they are tried.
CARD_SELECTORS = (".vehicle-card", ".inventory-item", ".vehicle-listing", ".car-listing", "[data-vehicle-id]", "[data-vin]", ".vehicle", ".inventory-vehicle", "article.vehicle", "div.vehicle", "li.vehicle", "tr.vehicle", "tr[data-vin]")
CARD_WORDS = ("vehicle", "inventory", "car", "listing", "item", "stock")
TEMPLATE_SELECTORS = (".vehicle-card", ".inventory-item", "[data-vehicle-id]")
DETAIL_PARTS = ("/vehicle/", "/inventory/", "/car/", "/detail/")
OTHER_PARTS = ("/contact", "/about", "/financing", "/service", "/directions")
_SELECTOR = re.compile(r"([a-z0-9]*)(?:\.([\w-]+)|\[([\w-]+)(?:([*]?=)\"([^\"]*)\")?( i)?\])?$")


@cache
def _parts(selector: str) -> tuple:
    return _SELECTOR.match(selector).groups()


def matches(node: Node, selector: str) -> bool:
    """tag, .class, tag.class, [attr], tag[attr], [attr="v"], [attr*="v"]."""
    tag, cls, attr, operator, value, _ = _parts(selector)
    if tag and node.name != tag:
        return False
    if cls:
        return cls in node.classes()
    if attr:
        held = node.attributes.get(attr)
        return held is not None and (operator is None or (value in held if operator == "*=" else value in (held.split() if attr == "rel" else [held])))
    return True


def card_selectors(profile: str) -> list[str]:
    if profile == "rendered":
        return list(CARD_SELECTORS[:11])
    return [*CARD_SELECTORS, *(s for w in CARD_WORDS for s in (f".{w}-card", f".{w}-item", f".{w}-listing", f'[class*="{w}"]'))]


def digits_price(text: str) -> float:
    try:
        return float("".join(c for c in text if c in "0123456789."))
    except ValueError:
        return 0.0


def text_price(text: str) -> float:
    found = _PRICE.search(text)
    return float(int(float(found[1].replace(",", "")))) if found else digits_price(text)


def _matching(nodes: list[Node], by_class: dict[str, list[Node]], selector: str) -> list[Node]:
    """The elements that a selector matches; one on classes is tried once per class attribute."""
    tag, cls, attr, operator, value, _ = _parts(selector)
    if cls or attr == "class" and operator == "*=":
        held = [c for c in by_class if (cls in c.split() if cls else value in c)]
        got = by_class[held[0]] if len(held) == 1 else sorted((n for c in held for n in by_class[c]), key=lambda n: n.number)
        return [n for n in got if n.name == tag] if tag else got
    return [n for n in nodes if matches(n, selector)] if operator or not attr else [n for n in nodes if attr in n.attributes and (not tag or n.name == tag)]


def _cards(root: Node, profile: str) -> list[Node]:
    if profile == "template":
        return [n for n in root.walk() if any(matches(n, s) for s in TEMPLATE_SELECTORS)]
    nodes, by_class = root.below(), {}
    for n in nodes:
        if "class" in n.attributes:
            by_class.setdefault(n.attributes["class"], []).append(n)
    for selector in card_selectors(profile):
        got = _matching(nodes, by_class, selector)
        if len(got) >= 2:
            return got
    if profile == "rendered":
        return []
    links = []
    for link in root.all("a"):
        href, text = link.attributes.get("href"), link.text().lower()
        if href is None or href and not href.startswith(("http://", "https://", "/", "#")):
            continue
        low = href.lower()
        if not any(p in low for p in OTHER_PARTS) and any(p in low for p in DETAIL_PARTS) and (any(w in text for w in ("new", "used")) or re.search(r"\d{4}", text)):
            links.append(link)
    return links


def list_cards(html: str | Node | None, base: str, profile: str = "generic") -> list[tuple[str, str, float | None]]:
    """H4: (detail address, title, price) of the vehicle cards of a list page.

    Profiles: generic (all selectors, then links), rendered (fewer selectors, no links),
    template (three selectors at once, no checks).
    """
    out = []
    for card in _cards(parse(html), profile):
        link = card if card.name == "a" else next((a for a in card.all("a") if "href" in a.attributes), None)
        href = link.attributes.get("href", "") if link is not None else ""
        if not href:
            continue
        try:
            address = urljoin(base, href)
        except ValueError:
            continue
        if profile == "template":
            heading = next((h for h in card.all("h2", "h3", "h4", part="title")), None)
            title = (heading or link).joined()
            cost = next(card.all(part="price"), None)
            out.append((address, title, digits_price(cost.joined()) if cost is not None else None))
            continue
        if not address.startswith(("http://", "https://")) or any(p in address.lower() for p in OTHER_PARTS):
            continue
        heading = card.find("h1", "h2", "h3", "h4") or next(card.all(part="title"), None) or next(card.all(part="name"), None)
        title = (heading or link).joined()
        priced = by_keyword(card, "price")
        cost = priced[0] if priced else next(card.all(part="price"), None) if profile == "generic" else None
        if title:
            out.append((address, title, text_price(cost.joined()) if cost is not None else None))
    return out


# Prices of a detail page.

#: Fixed: the kinds of prices in the order in which they are tried, and the words around them.
_CONTEXTS = (("msrp", ("msrp", "manufacturer", "sticker", "retail")), ("sale", ("sale", "our price", "internet", "e-price", "dealer price", "special")), ("total", ("total", "final", "out the door", "otd")))


def price_triple(text: str, elements: list[str] | None = None, compat: bool = False) -> tuple[float | None, float | None, float | None]:
    """(list, sale, total) prices by the words around each dollar amount.

    Every amount in the text is judged by the 50 characters around it. ``compat`` searches
    for the plain digits of each candidate instead (so amounts with commas are not found,
    and a short one is found at the front of a longer one, Q3); ``elements`` are then the
    texts of price elements, whose digits are candidates as well.
    """
    spans: list[tuple[float, int, int]] = []
    if compat:
        candidates: list = [int(float(m[1].replace(",", ""))) for m in _PRICE.finditer(text)]
        candidates += [digits_price(t) for t in elements or ()]
        for value in candidates:
            if value > 0:
                spans += [(float(value), m.start(), m.end()) for m in re.finditer(rf"\$\s*{re.escape(str(value))}", text)]
    else:
        spans = [(v, m.start(), m.end()) for m in _PRICE.finditer(text) if (v := float(int(float(m[1].replace(",", ""))))) > 0]
    by_kind: dict[str, list[float]] = {"msrp": [], "sale": [], "total": []}
    for value, start, end in spans:
        around = text[max(0, start - 50) : end + 50].lower()
        kind = next((k for k, words in _CONTEXTS if any(w in around for w in words)), None)
        if kind or not by_kind["sale"]:  # an amount of no kind counts as a sale price if it is the first
            by_kind[kind or "sale"].append(value)
    msrp, sale = max(by_kind["msrp"], default=None), min(by_kind["sale"], default=None)
    total = by_kind["total"][-1] if by_kind["total"] else None
    return msrp, sale, sale if total is None and sale else total


# Facts of a detail page.

_IMAGE_ENDS = (".jpg", ".jpeg", ".png", ".webp")


def images(root: Node, base: str, address: str, profile: str) -> list[str]:
    """H6: addresses of vehicle images."""
    words = {"generic": ("vehicle", "inventory", "car"), "rendered": ("vehicle", "inventory"), "template": ("vehicle",)}[profile]
    against = address if profile == "rendered" else base
    out = []
    for img in root.all("img"):
        held = img.attributes
        if profile != "rendered" and "src" not in held:
            continue
        src = held.get("src") or held.get("data-src") or (held.get("data-lazy-src") if profile != "template" else None)
        if not src:
            continue
        try:
            full = urljoin(against, src)
        except ValueError:
            continue
        low = full.lower()
        if profile == "template":
            if "vehicle" in src.lower():
                out.append(full)
        elif any(e in low for e in _IMAGE_ENDS) and any(w in low for w in words):
            out.append(full)
    return out if profile == "template" else out[:10]


def description(root: Node, profile: str) -> str | None:
    """H7: the first description-like block; the first substantial one of the four kinds, else the last found."""
    if profile == "rendered":
        return None
    if profile == "template":
        block = next(root.all("div", "p", part="description"), None)
        return block.joined() if block is not None else None
    out = None
    for word in ("description", "details", "overview", "about"):
        block = next(root.all("div", "p", "section", part=word), None)
        if block is not None:
            out = block.joined()
            if len(out) > 50:
                break
    return out


def features(root: Node, profile: str) -> list[str]:
    """H8: items of the first feature-like containers."""
    if profile == "rendered":
        return []
    if profile == "template":
        return [x.joined() for x in root.all("li", "span", part="feature")]
    out: list[str] = []
    for word in ("feature", "option", "equipment", "standard", "included"):
        for box in root.all("ul", "div", "dl", part=word):
            items = list(box.all("li")) or list(box.all("span", "div", "dt", "dd"))
            out += [x.joined() for x in items if 2 < x.leave[1] - x.enter[1] < 100]
            if len(out) >= 20:
                break
        if out:
            break
    return out[:20]


def is_inventory(root: Node, text: str) -> bool:
    """H9: words of an inventory, three vehicle-like blocks, or two price elements."""
    low = text.lower()
    if any(w in low for w in ("inventory", "vehicles", "browse", "available")):
        return True
    blocks = sum(any(n.class_has(w) for w in ("vehicle", "inventory", "car", "listing", "item")) for n in root.all("div", "article", "li"))
    return blocks >= 3 or len(by_keyword(root, "price")) >= 2


def facts(html: str | Node | None, base: str, address: str, profile: str = "generic") -> dict:
    """What a detail page holds for the extraction cascade (H2, H5-H9)."""
    root = parse(html)
    text = root.text().replace("\u00a0", " ")
    heading = root.find("h1") or root.find("h2" if profile == "template" else "title")
    title = root.find("title")
    low = text.lower() if text.isascii() else None
    engines, elements = [], root.below()
    for node in elements if any(_ENGINE.search(t.raw) for t in root.page.texts) else ():
        if node.name not in _HIDDEN and any(isinstance(c, str) and _ENGINE.search(c) for c in node.children):
            engines.append(node.text())
    return {
        "text": text,
        "title": title.text() if title is not None else None,
        "heading": heading.joined() if heading is not None else "",
        "json_ld": ["".join(c for c in s.children if isinstance(c, str)) for s in root.all("script") if s.attributes.get("type") == "application/ld+json"],
        "values": {f: v for f in ("vin", "stock_number", "mileage", "condition", "fuel_type", "availability", "colors") if (v := field_value(root, f, text, low)) is not None},
        "names": [x.joined() for x in by_keyword(root, "name")] if profile == "generic" else [],
        "statuses": [x.joined() for x in by_keyword(root, "availability")],
        "colors": [x.joined() for x in by_keyword(root, "colors")],
        "engines": engines,
        "prices": dict(zip(("msrp", "sale_price", "total_price"), price_triple(text))),
        "images": images(root, base, address, profile),
        "description": description(root, profile),
        "features": features(root, profile),
        "inventory": is_inventory(root, text),
    }


# Pagination.

#: Fixed: texts of next links, parts of addresses that count pages, and the addresses of counted pages.
NEXT_WORDS = ("next", ">", "»", "more", "show more")
PAGE_MARKS = ("page=", "p=", "/page/", "/p/", "?page", "&page")
PAGE_SHAPES = ("{stem}?page={n}", "{stem}?p={n}", "{stem}/page/{n}", "{stem}/p/{n}")
MOST_PAGES = 50


def _is_pager(link: Node) -> bool:
    label, classes = link.attributes.get("aria-label", ""), link.attributes.get("class", "")
    return link.in_pager or any(w in label for w in ("next", "Next", "page", "Page")) or "next" in link.attributes.get("rel", "").split() or "next" in classes or "page" in classes or "Next" in link.classes()


def page_links(html: str | Node | None, address: str) -> list[str]:
    """Addresses of the other pages of a list: numbered and next links, pager links, and, where
    the address counts pages, the synthetic ones of pages 2 to 50."""
    links = [(a, a.attributes["href"], a.joined()) for a in parse(html).all("a") if "href" in a.attributes]

    def resolved(href: str) -> str | None:
        try:
            return urljoin(address, href)
        except ValueError:
            return None

    def numbered(href: str, text: str) -> bool:
        return text.isdigit() and text.isascii() and 1 <= int(text) <= 200 and any(m in href.lower() for m in PAGE_MARKS)

    def other_list(full: str) -> bool:
        return full.startswith(("http://", "https://")) and not any(p in full.lower() for p in OTHER_PARTS[:-1])

    named = (resolved(href) for _, href, text in links if numbered(href, text) or text.lower() in NEXT_WORDS)
    pagers = (resolved(href) for link, href, _ in links if href and _is_pager(link))
    linked = [full for full in named if full is not None] + [full for full in pagers if full is not None and other_list(full)]
    parsed, counted = urlparse(address), []
    if "page" in parsed.query.lower() or "/page/" in parsed.path.lower():
        stem = address.split("?")[0].rsplit("/page/", 1)[0]
        counted = [shape.format(stem=stem, n=n) for n in range(2, MOST_PAGES + 1) for shape in PAGE_SHAPES]
    return list(dict.fromkeys([*(full for full in linked if full != address), *counted]))


def next_link(html: str | Node | None, address: str) -> str | None:
    """The page that a list page's next link leads to; null if none or not an inventory page."""
    links = [a for a in parse(html).all("a")]
    tests = (
        lambda a: "next" in a.attributes.get("aria-label", "").lower(),
        lambda a: {"next", "Next"} & set(a.classes()),
        lambda a: "next" in a.attributes.get("rel", "").split(),
        lambda a: "next" in a.attributes.get("class", "").lower(),
        lambda a: "href" in a.attributes and a.joined().lower() in NEXT_WORDS,
    )
    found = next((a for test in tests for a in links if test(a)), None)
    href = found.attributes.get("href", "") if found is not None else ""
    if not href:
        return None
    try:
        full = urljoin(address, href)
    except ValueError:
        return None
    return full if full.startswith(("http://", "https://")) and not any(p in full.lower() for p in OTHER_PARTS[:-1]) else None
