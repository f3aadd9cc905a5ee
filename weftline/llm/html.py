"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each at the end of a path of tags from the root. Per
path the length of the text, its punctuation and its links are summed over the page; a
path's ratio is text and punctuation per block, less the share that is link text. The
ratios in page order are smoothed over neighbouring blocks and fused with the path's own.
Blocks far below the weight of a typical content block do not tell where it is. The content is what the others
have in common: all that lies below the deepest element above them, whatever its length, but for
paths that are mostly links. Where one article or main element holds most of the weight, such elements are
the content whole and alone.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are known by their tags and by words in class, id and role; they do not count. A
word is believed where it is a name or its last part, or its first before parts of layout
only (``sidebar-left``, not ``has-sidebar`` or ``related-work``), never on article and main, and not
if what it would hide is most of the page's text that is not in links. Words for reader comments
are believed as long as a text is left beside them.

A header inside an article keeps its headings alone. An open select ends at the next block.
After 64 tags with quotes that nothing closes, a page's tags end at their first ``>``.

Character references are decoded, white space in a block becomes one space, and blocks are
joined by one space. NULL, empty and textless pages give an empty text. Pages are whole
rows: repeated ones give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

RAW = "script|style|noscript|template|iframe|textarea|svg|math|title|xmp|noembed|noframes"


def _token(attributes: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
        rf"|<(?P<raw>{RAW})\b{attributes}>.*?(?:</(?P=raw)\s*>|\Z)"
        rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>{attributes})>"
        r"|<[a-z/!?][^>]*>",
        re.S | re.I,
    )


#: A quote hides the end of a tag only where it begins a value.
QUOTED = _token(r"""(?:[^>=]++|=(?:\s*(?:"[^"]*"|'[^']*'))?)*+""")
#: Quotes do not hide the end of a tag.
PLAIN = _token("[^>]*+")
#: After so many tags with a quote that nothing closes, the quotes of a page are not followed any more: each of them is looked for up to its end.
BROKEN = 64
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[^a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text belongs to the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text.
OUTSIDE = frozenset("head nav header footer aside form button fieldset dialog menu select object canvas audio video".split())
#: Words in class, id or role of elements that are never main text.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice newsletter subscribe subscription share sharing social sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead comment comments reply replies disqus related recommended widget popup modal "
    "login signup pagination pager toolbar search contentinfo complementary alert".split()
)
#: Those of reader comments, which may well be longer than the text they are about.
COMMENTS = frozenset("comment comments reply replies disqus".split())
#: First parts of names that say what an element has or is for, not what it is.
ABOUT = frozenset("has have no not non with without is hide hides show shows open close toggle".split())
#: What may follow a word in a name.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons card col column container content count fixed form group "
    "head holder icon icons inner item items left link links list main outer panel post posts article articles primary "
    "right row secondary section slot text thread title top unit widget widgets wrap wrapper".split()
)
#: An open element that a new one of these ends by itself.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Elements that an end tag or an implied end does not reach out of.
WALLS = frozenset("ul ol dl table article section main body".split())
MAIN = frozenset(["article", "main"])
#: Block elements that do not end an open select.
CHOICES = frozenset("option optgroup hr".split())

SMOOTHING = np.array([0.25, 0.5, 1.0, 0.5, 0.25])
SHARE = 0.05
#: A single block beside an article, outside any other element, is a text of its own from so many characters on.
LINE = 200


def _word(name: str) -> str | None:
    """The word that tells that an element of this name (one of its classes, its id or role) is no main text."""
    parts = [p for p in PART.split(name) if p]
    if not parts or not ABOUT.isdisjoint(parts):
        return None
    if parts[-1] in OUTSIDE_WORDS:
        return parts[-1]
    return parts[0] if parts[0] in OUTSIDE_WORDS and LAYOUT.issuperset(parts[1:]) else None


def _outside(tag: str, attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether the element is no main text, and the words that say so if only they do."""
    if tag in OUTSIDE:
        return True, frozenset()
    words = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, frozenset()
        if name in ("class", "id", "role") and tag not in ("html", "body") and tag not in MAIN:
            words.update(map(_word, value.split()))
    return False, frozenset(words - {None})


def _believed(parts: list[tuple[str, bool, frozenset[str]]]) -> frozenset[str]:
    """Of the words around the parts of text, those that do not stand for most of the page."""
    sizes = [0 if link else len("".join(text.split())) for text, link, _ in parts]
    total = sum(sizes)
    hides: dict[str, int] = {}
    for (_, _, words), n in zip(parts, sizes):
        for word in words:
            hides[word] = hides.get(word, 0) + n
    small = frozenset(w for w, n in hides.items() if 2 * n <= total)
    for believed, least in ((small | (COMMENTS & hides.keys()), min(LINE, total)), (small, 1)):
        if sum(n for (_, _, words), n in zip(parts, sizes) if believed.isdisjoint(words)) >= least:
            return believed
    return frozenset()


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and raw elements, in time that follows the length of the page."""
    broken = 0
    last = page.rfind(">")
    at = page.find("<")
    while at >= 0:
        found = None
        # Without an end, only what lasts to the end of the page can begin.
        if at < last or page.startswith(("<!--", "<![CDATA["), at):
            found = (QUOTED if broken < BROKEN else PLAIN).match(page, at)
            broken += (found is None or not (found["tag"] or found["raw"])) and page[at + 1 : at + 2] not in ("!", "?", "<")
        if found:
            yield found
        at = page.find("<", found.end() if found else at + 1)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Blocks in page order that may be content: path of elements, text, length of link text.

    An element is its tag and its number in the page, so that paths tell elements apart.
    """
    found: list[tuple[tuple[str, ...], list[tuple[str, bool, frozenset[str]]]]] = []
    stack: list[tuple[str, int, frozenset[str]]] = []
    opened: Counter[str] = Counter()
    hidden = links = 0
    #: Open headers of an article; its title in there is its own.
    titled = 0
    text: list[tuple[str, bool, frozenset[str]]] = []
    words: frozenset[str] = frozenset()
    serial = 0

    def flush() -> None:
        if text:
            found.append((tuple(t for t, _, _ in stack if t.split("#")[0] not in INLINE), text.copy()))
            text.clear()

    def pop() -> None:
        nonlocal hidden, links, titled, words
        tag, out_of, words = stack.pop()
        opened[tag.split("#")[0]] -= 1
        hidden -= out_of
        links -= tag.startswith("a#")
        titled -= tag.startswith("header#") and in_main()

    def in_main() -> bool:
        return opened["article"] + opened["main"] > 0

    def close_until(names: frozenset[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            name = stack[i][0].split("#")[0]
            if name in names:
                while len(stack) > i:
                    pop()
                return
            if name in WALLS:
                return

    def add(part: str) -> None:
        if part and not hidden:
            text.append((part, links > 0, words))

    at = 0
    for token in _tokens(page):
        add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if token["close"]:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0].split("#")[0]
                if name == tag:
                    while len(stack) > i:
                        pop()
                    break
                if name in WALLS and tag not in WALLS and tag not in ("div", "html", "body"):
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag not in INLINE:
            close_until(frozenset(["p"]))
            if tag not in CHOICES:
                close_until(frozenset(["select"]))
            if tag in ENDS:
                close_until(ENDS[tag])
        serial += 1
        out_of, new = _outside(tag, token["attributes"])
        titled += tag == "header" and in_main()
        if tag in HEADINGS and hidden and hidden == titled and not out_of:
            out_of = -hidden
        stack.append((f"{tag}#{serial}", out_of, words))
        opened[tag] += 1
        words = words | new if new else words
        hidden += out_of
        links += tag == "a"
        if token["attributes"].rstrip().endswith("/") and tag not in INLINE:
            pop()
    add(page[at:])
    flush()
    believed = _believed([part for _, parts in found for part in parts])
    out = []
    for path, parts in found:
        parts = [part for part in parts if believed.isdisjoint(part[2])]
        joined = " ".join(unescape("".join(part for part, _, _ in parts)).split())
        if joined:
            out.append((path, joined, min(sum(len(part) for part, link, _ in parts if link), len(joined))))
    return out


def _names(path: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(t.split("#")[0] for t in path)


def _smoothed(values: np.ndarray) -> np.ndarray:
    if len(values) < len(SMOOTHING):
        return values
    return np.convolve(values, SMOOTHING, "same") / np.convolve(np.ones(len(values)), SMOOTHING, "same")


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    paths = [_names(path) for path, _, _ in found]
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([number[p] for p in paths])
    length = np.array([len(text) for _, text, _ in found], float)
    stops = np.array([len(PUNCTUATION.findall(text)) for _, text, _ in found], float)
    linked = np.array([n for _, _, n in found], float)
    n = np.bincount(of)
    own = 1 - np.bincount(of, linked) / np.bincount(of, length)
    ratio = np.bincount(of, length) / n * (1 + np.bincount(of, stops) / n) * own
    block = ratio[of]
    fused = np.sqrt(block * _smoothed(block))
    if fused.sum() <= 0:
        return ""
    outer = [next((path[: i + 1] for i, name in enumerate(names) if name in MAIN), None) for (path, _, _), names in zip(found, paths)]
    marked = np.array([r is not None for r in outer])
    most = 2 * fused[marked].sum() > fused.sum()
    if _settled(found, outer, fused):
        kept = marked
    else:
        least = SHARE * np.average(fused, weights=length - linked)
        typical = fused >= least
        root = _above([path for (path, _, _), t in zip(found, typical | (marked & most)) if t])
        inside = np.array([path[: len(root)] == root for path, _, _ in found])
        heading = np.array([not HEADINGS.isdisjoint(p) for p in paths])
        kept = inside & (typical | heading | (own[of] > 0.5) | (marked & most))
    return " ".join(text for (_, text, _), k in zip(found, kept) if k)


def _settled(found: list, outer: list[tuple[str, ...] | None], fused: np.ndarray) -> bool:
    """Whether the article and main elements are the content: one holds most of the weight, or a short line is all that is beside them."""
    own: dict[tuple[str, ...], float] = {}
    for r, w in zip(outer, fused):
        if r is not None:
            own[r] = own.get(r, 0.0) + w
    if not own:
        return False
    if 2 * max(own.values()) > fused.sum():
        return True
    beside = [(path, text) for (path, text, _), r in zip(found, outer) if r is None]
    if len(beside) != 1:
        return not beside
    path, text = beside[0]
    return len(text) < LINE and any(path[:-1] == r[:-1] for r in own)


def _above(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The deepest element above all ``paths``; a block is no frame, so elements that hold text themselves do not count."""
    low, high = min(paths), max(paths)
    n = 0
    while n < min(len(low), len(high)) - 1 and low[n] == high[n]:
        n += 1
    return low[: min(n, min(map(len, paths)) - 1)] if min(map(len, paths)) else ()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text`` and its length ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = [main_text(page) for page in part.column(column).to_pylist()]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": np.array([len(t) for t in texts], np.int64),
                    }
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", column).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
