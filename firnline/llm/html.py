"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from firnline.llm.labelled_pages import LABELLED
from firnline.llm.text import col

# Elements whose content is no text; elements that do not end a block; elements without content.
HIDDEN = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map select datalist head title textarea button".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
#: Of these, elements whose content is no markup: it goes to their end tag, whatever stands in it.
PLAIN = RAW - frozenset("template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and roles that hold main or other text, and words in class or id that tell.
MAIN_TAGS, SIDE_TAGS = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "form", "dialog", "menu"))
MAIN_ROLES = frozenset(("main", "article"))
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
                       "header masthead footer sidebar aside rail widget widgets cookie cookies consent gdpr notice alert popup modal overlay comment comments "
                       "reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription "
                       "signup login breadcrumb breadcrumbs pagination pager toolbar search skip legal copyright disclaimer form".split())
MAIN_NAMES = frozenset("article content main post entry story body text maintext articlebody".split())
#: Names by which even an element of main text holds other text, wherever it stands.
NEVER_MAIN = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments reply replies cookie cookies".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in PLAIN}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What the tree sees of a block: words and share of linked words of the block before, its own and the one after;
#: whether it stands in an element of main text, in one of other text, and whether it is a heading. Where there is no
#: block before or after, the block itself stands for it, so that the first and the last are not judged by an absence.
FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "main", "side", "heading")
DEPTH, LEAST_LEAF = 8, 2


def zone(tag: str, attributes: str, around: int = 0) -> tuple[int, bool]:
    """(1 for an element of main text, -1 of other text, 0 neither; whether it is hidden). ``around`` is the zone it stands in."""
    hidden, names, role = False, set(), ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = m[0].lower() == "hidden"
        elif key == "role":
            role = value.strip().lower()
        else:
            names.update(x.lower() for x in _NAME.findall(value))
    if tag in SIDE_TAGS or role in SIDE_ROLES:
        return -1, hidden
    if tag in MAIN_TAGS or role in MAIN_ROLES:
        # An article that is called featured or related is one of the page's own, unless it stands in another.
        return (-1 if names & (SIDE_NAMES - MAIN_NAMES if around else NEVER_MAIN) else 1), hidden
    if tag in ("html", "body"):
        return 0, hidden
    if names & SIDE_NAMES:
        return -1, hidden
    return (1 if names & MAIN_NAMES else 0), hidden


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """(text, features) of the flat text blocks of a page, in order.

    A block is the text between two tags that are not inline. An element's
    zone is that of the nearest element around it that has one; a ``header``
    is other text unless it stands in main text.
    """
    found: list[list] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, zone, hidden, in a link
    linked: list[str] = []
    heading = False

    def end() -> None:
        nonlocal pieces, linked, heading
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                words = len(text.split())
                links = min(1.0, len(unescape(" ".join(linked)).split()) / words) if linked else 0.0
                around = stack[-1][1] if stack else 0
                found.append([text, words, links, around > 0, around < 0, heading])
            pieces, linked = [], []
    at = 0
    raw = ""
    limit = html.rfind(">") + 1  # behind the last > is only text
    tokens = _TOKEN.finditer(html, 0, limit)
    while m := next(tokens, None):
        if m.start() > at and not (stack and stack[-1][2]):
            pieces.append(html[at:m.start()])
            if stack and stack[-1][3]:
                linked.append(pieces[-1])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if tag in PLAIN and raw not in ("svg", "math") and not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
            end_tag = _END[tag].search(html, at, limit)
            tokens = _TOKEN.finditer(html, end_tag.start() if end_tag else limit, limit)
        if not tag or (raw and tag != raw):
            continue
        if tag not in INLINE and tag not in RAW:
            end()
        elif tag in ("br", "wbr", "img"):
            if tag == "br" and not (stack and stack[-1][2]):
                pieces.append(" ")
            continue
        if closing:
            raw = ""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif tag not in VOID:
            attributes = m[3] or m[6] or ""
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and not attributes.endswith("/"):
                _close(stack, tag)
            around, hidden, link = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (0, False, False)
            own, unseen = zone(tag, attributes, around)
            if tag == "header" and own == 0:
                own = -1 if around <= 0 else 0
            # What is other text stays so until an element of main text starts that is not inside it by name alone.
            here = own if own and not (own > 0 and around < 0 and tag not in MAIN_TAGS) else around
            stack.append((tag, here, hidden or unseen or tag in HIDDEN, link or tag == "a"))
            if tag in RAW and not attributes.rstrip().endswith("/"):
                raw = tag
        heading = any(len(t) == 2 and t[0] == "h" and t[1].isdigit() for t, *_ in stack[-3:])
    if at < len(html) and not (stack and stack[-1][2]):
        pieces.append(html[at:])
    end()
    out = []
    for i, (text, words, links, main, side, head) in enumerate(found):
        before = found[max(i - 1, 0)]
        after = found[min(i + 1, len(found) - 1)]
        out.append((text, [before[1], words, after[1], before[2], links, after[2], float(main), float(side), float(head)]))
    return out


def _close(stack: list, tag: str) -> None:
    """End an open element of the same kind whose end tag was left out; what is inline in it ends too."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            del stack[k:]
            return
        if stack[k][0] not in INLINE:
            return


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST_LEAF):
    """A decision tree by Gini impurity: a share of main text, or (feature, limit, tree up to it, tree beyond)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(values[1:] > values[:-1]) + 1
        cut = cut[(cut >= least) & (len(y) - cut >= least)]
        if not len(cut):
            continue
        left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
        impurity = left * (cut - left) / cut + right * (len(y) - cut - right) / (len(y) - cut)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0] - 1e-12:
            best = float(impurity[k]), f, float(values[cut[k] - 1] + values[cut[k]]) / 2
    if best is None:
        return share
    _, f, limit = best
    low = x[:, f] <= limit
    return f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def verdict(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if features[f] <= limit else high
    return tree > 0.5


_NAMED = re.compile(r"""\s(?:class|id|role)="[^"]*\"""")
_ZONED = re.compile(r"(</?)(?:article|main|nav|aside|footer|header|section|form|menu)\b")


def unnamed(page: str) -> str:
    """A page without the names, roles and tags that tell where its main text is."""
    return _ZONED.sub(r"\1div", _NAMED.sub("", page))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; main text is marked there with «».

    Each page counts twice, the second time without what tells its zones, so
    that words and links have to decide. Other text that only a name tells
    from main text (an advert of a few sentences) is left out there.
    """
    x, y = [], []
    for page in LABELLED:
        for text, features in blocks(page):
            x.append(features)
            y.append("«" in text)
        for text, features in blocks(unnamed(page)):
            if "«" in text or features[1] < 9 or features[4] > 0.5:
                x.append(features)
                y.append("«" in text)
    return np.array(x, float), np.array(y, float)


@lru_cache
def trained():
    return grow(*labelled_blocks())


def main_text(html: str | None, tree=None) -> str:
    """The blocks that the tree takes for main text, a line each."""
    tree = trained() if tree is None else tree
    return "\n".join(text for text, features in blocks(html or "") if verdict(tree, features))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; a null or empty page has an empty text.

    Pages are judged one by one, whole; repeated rows and null ids give a
    result each and other columns are ignored.
    """
    tree = trained()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(h.as_py(), tree) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(col(pages, "page_id").cast("long").alias("page_id"), col(pages, "url").cast("string").alias("url"), col(pages, "html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
