"""Main text of web pages by tag-path ratios.

Blocks of text are grouped by their tag path from the root. A path's ratio is its text length per block,
fused with its punctuation per block and with the share of text outside links; the ratios are smoothed along
the page, so that short blocks between long ones gain. Paths above a share of the best one are content;
the article or main element around them, or else their common ancestor, is the article, and its blocks are
kept but for navigation, notices, adverts, forms, comments and the like, which elements and names tell.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and role names of the HTML standard, and common class names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var br wbr img".split()
)
RAW = "script style noscript template textarea svg iframe title math object"
FURNITURE = set("nav header footer aside form button select option dialog head menu fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set(
    "ad ads adv advert advertisement adverts sponsored sponsor promo promotion banner cookie cookies consent gdpr notice"
    " notices popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs header"
    " masthead footer sidebar aside widget widgets related recommended share sharing social comment comments disqus"
    " reply replies respond toolbar pagination pager search login copyright skip".split()
)
# A name after the first or before the second tells what a page has or does, as in has-sidebar and comments-open.
STATES = set("has have no not with without is hide show".split())
STATE_ENDS = set("open opened closed enabled disabled active inactive on off visible hidden collapsed expanded".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = set("ul ol dl table body html article main section div td th nav aside footer header form".split())
HOMES = ("article", "main")

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW.split())})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
SMOOTH = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
SHARE = 0.1


class Element:
    __slots__ = ("tag", "path", "parent", "furniture", "named")

    def __init__(self, tag: str, path: int, parent: Element | None, furniture: bool, named: bool):
        self.tag, self.path, self.parent, self.furniture, self.named = tag, path, parent, furniture, named


def names_furniture(value: str) -> bool:
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        for x in parts:
            if x in STATES or parts[-1] in STATE_ENDS:
                break
            if x in NAMES:
                return True
    return False


def is_furniture(tag: str, rest: str) -> tuple[bool, bool]:
    """Whether the element or its role says so, and whether a class or id does."""
    named = False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            named = named or tag not in ("html", "body", "main") and names_furniture(value)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True, named
    return tag in FURNITURE, named


def settle(elements: list[Element], found: list[tuple[Element, str, int]]) -> None:
    """Marks the elements that names make furniture, and all elements inside furniture.

    Names do not count for what holds the page: the largest article, if it has more text than all elements without
    such names, and an element with most of the text outside links, unless an article, main or h1 is elsewhere.
    """
    place = {id(e): k for k, e in enumerate(elements)}
    parent = [place.get(id(e.parent), -1) for e in elements]
    n = len(elements)
    under_name, plain, free = [False] * n, [0] * n, 0
    for k, e in enumerate(elements):
        e.furniture = e.furniture or parent[k] >= 0 and elements[parent[k]].furniture
        under_name[k] = e.named or parent[k] >= 0 and under_name[parent[k]]
    if not any(e.named for e in elements):
        return
    for e, t, linked in found:
        k = place[id(e)]
        if not e.furniture:
            plain[k] += max(len(t) - linked, 0)
            free += 0 if under_name[k] else max(len(t) - linked, 0)
    for k in range(n - 1, 0, -1):
        plain[parent[k]] += plain[k]
    total = plain[0]
    articles = [k for k, e in enumerate(elements) if e.tag == "article" and not e.named and not e.furniture]
    holders: set[int] = set()
    at = max(articles, key=lambda k: plain[k], default=-1)
    if at >= 0 and plain[at] > free:
        while at >= 0:
            holders.add(at)
            at = parent[at]
    small, homes = [False] * n, [0] * n
    for k, e in enumerate(elements):
        small[k] = e.furniture or e.named and k not in holders and 2 * plain[k] <= total or k > 0 and small[parent[k]]
        homes[k] = int(e.tag in ("article", "main", "h1") and not small[k])
    for k in range(n - 1, 0, -1):
        homes[parent[k]] += homes[k]
    for k, e in enumerate(elements):
        named = e.named and k not in holders and not (2 * plain[k] > total and homes[k] == homes[0])
        e.furniture = e.furniture or named or k > 0 and elements[parent[k]].furniture


def blocks(page: str) -> list[tuple[Element, str, int]]:
    """(element, text, characters in links) of every block with text, in page order."""
    paths: dict[tuple[int, str], int] = {}
    root = here = Element("", 0, None, False, False)
    elements = [root]
    found: list[tuple[Element, str, int]] = []
    parts: list[str] = []
    in_link = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((here, text, linked))
        parts.clear()
        linked = 0

    def text_part(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw))
            if in_link:
                linked += len(parts[-1])

    at = 0
    for m in MARKUP.finditer(page):
        text_part(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if m["close"] else 1
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag == "br" else "")
            elif not m["close"] and any(marks := is_furniture(tag, m["rest"])) and not m["rest"].endswith("/"):
                flush()
                key = paths.setdefault((here.path, tag), len(paths) + 1)
                here = Element(tag, key, here, *marks)
                elements.append(here)
            elif m["close"] and here.tag == tag:
                flush()
                here = here.parent or root
            continue
        flush()
        if m["close"]:
            target = here
            while target is not root and target.tag != tag:
                target = target.parent
            if target is not root:
                here = target.parent
            continue
        if tag in VOID or m["rest"].endswith("/"):
            continue
        closing = CLOSES.get(tag, set()) | {"p"}
        target = here
        while target is not root and target.tag not in SCOPES and target.tag not in closing:
            target = target.parent
        if target is not root and target.tag in closing:
            here = target.parent
        key = paths.setdefault((here.path, tag), len(paths) + 1)
        here = Element(tag, key, here, *is_furniture(tag, m["rest"]))
        elements.append(here)
    text_part(page[at:])
    flush()
    settle(elements, found)
    return found


def path_scores(found: list[tuple[Element, str, int]]) -> np.ndarray:
    """The fused and smoothed ratio of each block's path; blocks in page furniture have none."""
    paths = np.array([e.path for e, _, _ in found])
    live = np.array([not e.furniture for e, _, _ in found])
    length = np.array([len(t) for _, t, _ in found], float) * live
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in found], float) * live
    plain = np.array([max(len(t) - k, 0) for _, t, k in found], float) * live
    _, own, nodes = np.unique(paths, return_inverse=True, return_counts=True)
    total = np.bincount(own, length)
    ratio = total / nodes * (1 + np.bincount(own, marks) / nodes) * np.bincount(own, plain) / np.maximum(total, 1)
    along = np.convolve(ratio[own], SMOOTH / SMOOTH.sum(), "same") if len(own) >= len(SMOOTH) else ratio[own]
    fused = np.bincount(own, np.sqrt(ratio[own] * along)) / nodes
    return fused[own] * live


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(found)
    if not scores.max() > 0:
        return ""
    chosen = [e for (e, _, _), s in zip(found, scores, strict=True) if s >= SHARE * scores.max()]

    def ancestors(e: Element) -> list[Element]:
        line = []
        while e is not None:
            line.append(e)
            e = e.parent
        return line

    homes: list[Element] = []
    for e in chosen:
        own = [a for a in ancestors(e) if a.tag in HOMES]
        homes += [own[-1]] if own else []
    if not homes:
        common = ancestors(chosen[0])
        for e in chosen[1:]:
            line = set(map(id, ancestors(e)))
            common = [a for a in common if id(a) in line]
        homes = common[:1]
    inside = {id(a) for a in homes}
    kept: dict[int, bool] = {}

    def within(e: Element) -> bool:
        line = []
        while e is not None and id(e) not in kept and id(e) not in inside:
            line.append(e)
            e = e.parent
        result = e is not None and (id(e) in inside or kept.get(id(e), False))
        kept.update((id(x), result) for x in line)
        return result

    return "\n".join(
        t for e, t, k in found if not e.furniture and within(e) and not (e.tag == "li" and k >= 0.8 * len(t))
    )


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. A null or empty page has an empty text.

    One row per input row, repeated or not; columns other than page_id, url and html are not looked at. ``br`` is
    white space inside its block, and so is a non-breaking space.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
